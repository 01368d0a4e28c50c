import json

from citelake.functions import catalogue_text, scoring
from citelake.operators import evaluation, page_agent
from citelake.sources.catalogue import seed_entries

GOLD = [{"name": "Alpha", "price": "$10.00"}, {"name": "Beta", "price": "$20"}]


def match(guess, gold):
    return scoring.agree(scoring.form(guess), scoring.form(gold))


def test_value_matching():
    assert match("10", "$10.00") and match("£10.004", "$10.00") and not match("11", "10") and not match(None, "10")
    assert match("“Hello…”", "hello...") and not match("", "")
    assert match("May 5, 2024", "may 5, 2024") and scoring.form(True).number is None and scoring.form("1 2").number is None and scoring.form(3).number == 3.0


def test_scores(spark):
    task = json.dumps({"records_field": "r", "key": "name", "fields": ["name", "price"]})
    guess = [GOLD[0] | {"price": "9"}, {"name": "Gamma", "price": ""}, "junk"]
    rows = [("same", task, json.dumps(GOLD), json.dumps({"r": GOLD})), ("some", task, json.dumps(GOLD), json.dumps({"r": guess})), ("none", task, json.dumps(GOLD), "no reply"), ("empty", task, "[]", "{}")]
    scores = evaluation.score_fixtures(spark.createDataFrame(rows, "fixture string, task string, gold string, data string"))
    got = {r["fixture"]: r for r in scores.collect()}
    assert got["same"]["f1"] == 1.0 and got["same"]["matched_records"] == 2
    r = got["some"]
    assert (r["tp"], r["fp"], r["fn"]) == (1, 2, 3) and r["invented_records"] == 1 and r["predicted_records"] == 2 and r["gold_records"] == 2
    assert got["none"]["recall"] == 0.0 and got["none"]["fn"] == 4 and got["empty"]["f1"] == 0.0 and got["empty"]["gold_records"] == 0
    text = evaluation.report(evaluation.summarise(scores), scores).first()["value"]
    assert "* fixtures: 4" in text and text.count("\n| ") == 5


def test_report_files(spark, tmp_path):
    scores = spark.createDataFrame([("a", 1, 0, 0, 1.0, 1.0, 1.0, 0)], "fixture string, tp long, fp long, fn long, precision double, recall double, f1 double, invented_records long")
    evaluation.write_report(evaluation.summarise(scores), scores, f"file://{tmp_path}/run")
    assert (tmp_path / "run/report.md").read_text().startswith("# Scores") and spark.read.json(f"file://{tmp_path}/run/scores.json").count() == 1


def test_pairing_uses_each_prediction_once():
    assert scoring.partners([{"k": "1"}, {"k": "1"}, {"k": "3"}], [{"k": "1"}, {"k": "1"}, {"k": "2"}], "k") == [0, 1, None]


NODES = "run int, step int, pos int, id int, role string, text string, x long, y long"


def nodes(spark, steps=(1,)):
    return spark.createDataFrame([r for k in steps for r in ((1, k, 1, 1, "button", "Go", 5, 6), (1, k, 2, 2, "input", "", 7, 8))], NODES)


def test_actions(spark):
    replies = [
        "x", '{"type": "fly"}', '{"type": "click", "id": "1"}', '{"type": "type", "x": 7, "y": 8, "value": "v"}', '{"type": "click", "x": "1", "y": 2}', '{"type": "click"}',
        '{"type": " Scroll"}', json.dumps({"type": "stop", "reason": "r" * 300}), '[{"action": {"type": "stop"}}]', None,
    ]
    rows = spark.createDataFrame([(1, k, r) for k, r in enumerate(replies)], "run int, step int, reply string")
    got = [{k: v for k, v in r.asDict().items() if v is not None and k not in page_agent.STEP} for r in page_agent.actions(rows, nodes(spark, range(10))).orderBy("step").collect()]
    assert [g["type"] for g in got] == ["stop", "stop", "click", "type", "click", "stop", "scroll", "stop", "stop", "stop"]
    assert got[2] == {"type": "click", "x": 5, "y": 6, "element_id": 1} and got[3]["element_id"] == 2 and got[3]["value"] == "v"
    assert got[4] == {"type": "click", "x": 1, "y": 2} and got[6] == {"type": "scroll"} and got[7]["reason"] == "r" * 200 and got[8] == {"type": "stop"}
    assert all("error" in got[k] for k in (0, 1, 5, 9))


def test_keyword_planner(spark):
    goals = spark.createDataFrame([(1, 1, "find", ""), (1, 2, "find", "abc"), (2, 1, "all done", ""), (2, 2, "find", None)], "run int, step int, goal string, typed string")
    seen = nodes(spark, (1, 2)).where("step = 1 or id = 1")
    got = {(r["run"], r["step"]): r for r in page_agent.planned(goals, seen).collect()}
    assert got[1, 1]["element_id"] == 2 and got[1, 1]["value"] == "find" and got[1, 2]["type"] == "click" and got[1, 2]["value"] is None
    assert got[2, 1]["type"] == "stop" and got[2, 1]["error"] is None and got[2, 2]["error"]
    assert page_agent.planned(goals.limit(0), seen).count() == 0


def test_outcomes_and_lines(spark):
    action = "struct<type:string,element_id:int,value:string,error:string>"
    rows = [
        (1, 1, ("stop", None, None, None), True, "a", "a"), (2, 1, ("click", None, None, None), True, "a", "a"), (3, 1, ("scroll", None, None, None), True, "a", "b"),
        (4, 1, ("stop", None, None, "lost"), True, "a", "a"), (5, 1, ("type", 3, "v", None), False, "a", "a"), (6, 1, ("scroll", None, None, None), True, "a", "a"), (6, 2, ("stop", None, None, None), True, "a", "a"),
    ]
    steps = spark.createDataFrame(rows, f"run int, step int, action {action}, performed boolean, url_before string, url_after string")
    none = nodes(spark).limit(0)
    got = {r["run"]: (r["success"], r["error"]) for r in page_agent.outcomes(steps, none, 3).collect()}
    assert got[1] == (True, None) and got[2] == (False, "no element to act on") and got[3][1] == "no end within 3 steps" and got[4] == (False, "lost")
    assert got[5] == (False, "could not perform: type") and got[6] == (True, None)
    assert {r["run"]: r["success"] for r in page_agent.outcomes(steps, none, 1).collect()}[6] is False
    lines = {r["run"]: r["lines"] for r in page_agent.step_lines(steps).collect()}
    assert lines[6].count("\n") == 1 and "-> b" in lines[3] and "on 3" in lines[5]
    assert page_agent.element_lines(nodes(spark)).first()["lines"].count("\n") == 1


def test_catalogue_texts():
    entries = {e["id"]: e for e in seed_entries()}
    assert len(entries) == 15 and len(entries["api-finance-02"]["endpoints"]) == 2 and not entries["api-ai-07"]["https"]
    assert catalogue_text.class_name("Blockchain.info API") == "ApiClient" and catalogue_text.class_name("Open-Meteo API") == "OpenMeteoApiClient"
    assert catalogue_text.method_name("/rawblock/{block_hash}") == "get_rawblock_block_hash" and catalogue_text.method_name("/") == "get_get_root"
    compile(catalogue_text.connector(entries["api-chain-14"]), "x", "exec")
    assert "client.forecast()" in catalogue_text.reference_page(entries["api-weather-01"])
