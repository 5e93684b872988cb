import json

from fixtures import VERDICTS, text_of

from histlens import api


def test_strings(spark):
    skew, bad = text_of(VERDICTS["write skew"][0]), "[x:=1"
    df = spark.createDataFrame([("skew", skew), ("bad", bad)], "h string, text string")
    got = {r["h"]: r for r in api.check_text(df, "serializable").collect()}
    assert (got["skew"]["ok"], got["skew"]["error_kind"], got["bad"]["error_kind"]) == (False, "Invalid", "Parse")
    as_json = api.text_to_json(df)
    one = {r["h"]: json.loads(r["json"]) for r in as_json.collect()}
    assert list(one) == ["skew"] and one["skew"][0][0] == {"events": [{"Write": {"variable": 0, "version": 1}}, {"Write": {"variable": 1, "version": 1}}], "committed": True}
    assert [r["ok"] for r in api.check_json(as_json, "snapshot-isolation").collect()] == [True]
    shown = json.loads(api.trace_json(as_json, "snapshot-isolation").first()["trace"])
    assert shown["ok"] and shown["session_count"] == 3 and len(shown["witness_edges"]) > 0
    assert api.check_json(spark.createDataFrame([("x", "{")], "h string, json string"), "causal").first()["error_kind"] == "Parse"
