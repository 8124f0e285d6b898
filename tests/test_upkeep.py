from datetime import datetime

from pyspark.sql import functions as F

from tests.conftest import rows
from vacancia.functions import markup, messages
from vacancia.operators import upkeep

NOW = datetime(2026, 1, 31)
PREFERENCE = "profile_id string, channel string, is_paused boolean, paused_at timestamp, resumed_at timestamp"


def test_pause_and_resume(spark):
    none = spark.createDataFrame([("q", "t", False, None, None)], PREFERENCE)
    paused = upkeep.set_paused(none, "p", "t", True, NOW)
    assert rows(paused) == [("p", "t", True, NOW, None), ("q", "t", False, None, None)]
    later = datetime(2026, 2, 1)
    assert rows(upkeep.set_paused(paused, "p", "t", False, later))[0] == ("p", "t", False, NOW, later)


def test_messages_come_alive_again(spark):
    schema = "telegram_message_id long, delivery_id long, deleted_at timestamp"
    known = spark.createDataFrame([(1, 10, NOW), (2, 20, None)], schema)
    sent = spark.createDataFrame([(1, 11), (3, 30)], "telegram_message_id long, delivery_id long")
    alive = upkeep.record_messages(known, sent)
    assert rows(alive) == [(1, 11, None), (2, 20, None), (3, 30, None)]
    gone = upkeep.mark_deleted(alive, sent, NOW)
    assert [r[0] for r in upkeep.active_messages(gone).collect()] == [2]


def test_rechecks_take_turns(spark):
    df = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "x", 1), ("b", "z", 2), ("c", "w", 1)], "parent string, child string, position int")
    assert [tuple(r) for r in upkeep.rechecks(df, 3).collect()] == [("a", "x"), ("c", "w"), ("a", "y")]


def test_description_text():
    html = "<p>One&nbsp;two</p><script>x()</script><ul><li>a</li><li>b &amp; c</li></ul>tail<br>end"
    assert markup.description(html) == "One two\n- a\n- b & c\ntail\nend"
    assert markup.description(None) is None and markup.description("") == ""


def test_nested_values():
    value = {"skills": [{"name": "A", "slug": " "}, "B", {"other": "C"}], "apply": {"url": "https://x/"}, "logo": "https://y/", "auth": {"Password": "p", "n": 1}}
    assert list(markup.strings(value["skills"])) == ["A", "B"]
    assert list(markup.links(value)) == ["https://x/"]
    assert markup.hide(value)["auth"] == {"Password": "[REDACTED]", "n": 1}


def test_secrets_in_texts_are_hidden():
    assert markup.hide({"note": "token=abc Authorization: Bearer XYZ"}) == {"note": "token=abc Authorization: [REDACTED] [REDACTED]"}
    assert markup.hide(["https://u:p@h/?token=1", {"a": ["api_key: k, x"]}, 5, None]) == ["https://u:[REDACTED]@h/?token=[REDACTED]", {"a": ["api_key: [REDACTED], x"]}, 5, None]
    assert markup.hide("123456:" + "a" * 20) == "[REDACTED]" and markup.hide({"Bot-Token": {"x": 1}}) == {"Bot-Token": "[REDACTED]"}


def test_nested_lists_and_names_keep_their_order():
    value = [["a", {"slug": "s", "name": "n", "title": {"name": "deep"}}], "b", [["c"]], {"label": ["no"]}, 7]
    assert markup.strings(value) == ["a", "n", "s", "b", "c"] and markup.strings("x") == ["x"] and markup.strings({"title": "t", "name": "n"}) == ["n", "t"] and markup.strings(None) == []
    assert markup.links({"links": [{"href": "https://a"}, ["https://b"]], "apply_to": {"x": ["http://c"]}, "url": 1}) == ["https://b"]


def test_explanations_and_messages(spark):
    df = spark.createDataFrame([("unpaid", "a<b", 40), ("language_german", None, 60), (None, "c", 10)], "code string, company string, score int")
    said = [r[0] for r in df.select(messages.explain(F.col("code"))).collect()]
    assert said == ["Rejected: unpaid or volunteer work.", "Rejected: language (german).", None]
    empty = F.array().cast("array<string>")
    told = [r[0] for r in df.select(messages.match_message(F.lit("T"), F.col("company"), F.col("score"), empty, empty, F.lit("u"))).collect()]
    assert told == ["<b>T</b> (Explore)\na&lt;b\nScore: 40\nu", "<b>T</b>\nScore: 60\nu", "<b>T</b>\nc\nScore: 10\nu"]
    assert messages.text_table(df.select("score")) == "score\n40\n60\n10"
    assert rows(messages.as_json(df.where("score = 10"))) == [('{"code":null,"company":"c","score":10}',)]


def test_backfills(spark):
    reasons = spark.createDataFrame([(["Skills: A, B."],), (["none"],)], "reasons array<string>")
    assert [r["matched_skills"] for r in upkeep.backfill_skills(reasons, "Skills: ").collect()] == [["A", "B"], []]


def test_messages_of_any_user_are_repointed(spark, tmp_path):
    from vacancia.plans import QUERIES

    ids = [0, 1, 5, 4999, 5002, 700_001]
    spark.createDataFrame([(i, u, NOW) for i, u in enumerate(ids)], "event_id long, user_id long, ts timestamp_ntz").write.parquet(str(tmp_path / "events.parquet"))
    assert rows(QUERIES["j16_repoint_messages"](spark, str(tmp_path))) == [(i, u - u % 3) for i, u in enumerate(ids)]
