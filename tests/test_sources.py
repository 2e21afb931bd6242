"""Files in and out, run history, and Markdown lines."""

import json

import pytest
from pyspark.sql import functions as F

from scorelake.functions import markdown
from scorelake.functions import text as T
from scorelake.operators import judging, runs, validate
from scorelake.sources import commits, datasets, history, scratch


def _example(i, version="v1", **more):
    return {"id": i, "input": "q é", "expected_outputs": [{"kind": "exact", "value": "a"}], "dataset_version": version, "provenance": {"b": 1, "a": [1.5]}, **more}


def _cal(i, score=0.5, **more):
    return {"id": i, "prompt": "p", "response": "", "rubric": "r", "human_score": score, "provenance": {}, **more}


def _file(tmp_path, lines, name="in.jsonl"):
    (tmp_path / name).write_text("\n".join(lines) + "\n" if lines else "")
    return str(tmp_path / name)


def test_lines_are_numbered_over_splits(spark, tmp_path):
    lines = ["" if i % 7 == 0 else f"line {i} " + "x" * (i % 50) for i in range(1, 2001)]
    path = _file(tmp_path, lines)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = datasets.numbered_lines(spark, path)
        assert spark.read.text(path).rdd.getNumPartitions() > 3
        assert [(r["line_no"], r["line"]) for r in rows.orderBy("line_no").collect()] == list(enumerate(lines, 1))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_golden_round_trip_and_first_bad_line(spark, tmp_path):
    rows = [_example("a", tags=["x"]), _example("b")]
    lines = [json.dumps(r, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in rows]
    loaded = datasets.load_golden(spark, _file(tmp_path, lines))
    datasets.write_golden(loaded, str(tmp_path / "out"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()] == lines
    assert [r["id"] for r in datasets.load_golden(spark, _file(tmp_path, lines), ["x", "z"]).collect()] == ["a"]
    with pytest.raises(ValueError, match="no example"):
        datasets.load_golden(spark, _file(tmp_path, lines), ["z"])
    with pytest.raises(datasets.LoadError) as e:
        datasets.load_golden(spark, _file(tmp_path, [lines[0], lines[0], "{"]))
    assert e.value.line_no == 2
    with pytest.raises(datasets.LoadError) as e:
        datasets.load_golden(spark, _file(tmp_path, []))
    assert e.value.line_no == 0


def test_canonical_output_as_one_file(spark, tmp_path):
    """300 examples in mixed order over several parts: the same bytes as one json.dumps a line; then replaced by fewer."""
    rows = [_example(f"é{i}", tags=["x"] if i % 2 else [], provenance={"z": i, "a": {"c": 1, "b": "\u001f"}}) for i in range(300)]
    dumps = lambda r: json.dumps({k: v for k, v in r.items() if k != "tags" or v}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    loaded = datasets.load_golden(spark, _file(tmp_path, [json.dumps(r) for r in rows]))
    path = tmp_path / "out" / "golden.jsonl"
    for n in (300, 7):
        datasets.write_golden_file(loaded.where(F.col("line_no") <= n).repartition(6, "id"), str(path))
        assert path.read_text(encoding="utf-8") == "".join(dumps(r) + "\n" for r in rows[:n])
        assert [p.name for p in path.parent.iterdir() if not p.name.endswith(".crc")] == ["golden.jsonl"]
    datasets.write_golden_file(loaded.where("line_no < 0"), str(path))
    assert path.read_text() == ""


def test_calibration_outcomes(spark, tmp_path):
    cases = [_cal("a"), _cal("b", 1.5), _cal("c", True), _cal("a"), _cal("d", rubric=" "), _cal("e", extra=1), _cal("b", 1), _cal("f", float("nan"))]
    lines = [*map(json.dumps, cases), "", " "]
    df = spark.createDataFrame(list(enumerate(lines, 1)), "line_no long, line string")
    got = {r["line_no"]: (r["code"], r["reason"]) for r in validate.calibration_outcomes(df).collect()}
    assert [got[i][0] for i in range(1, 11)] == ["valid", "score_range", "schema", "duplicate_id", "schema", "schema", "valid", "score_range", "parse", "parse"]
    blank = "blank line; calibration must have one JSON object per line"
    assert got[9][1] == got[10][1] == blank and got[4][1] == "duplicate id 'a'; first seen at line 1; ids must be unique within a file"
    with pytest.raises(datasets.LoadError, match="line 2: invalid JSON: Expecting value"):  # loaded, white space is no blank line
        datasets.load_calibration(spark, _file(tmp_path, [json.dumps(_cal("a")), " "]))
    assert datasets.load_calibration(spark, _file(tmp_path, [json.dumps(_cal("a", 1))])).first()["human_score"] == 1.0
    assert datasets.load_calibration(spark, _file(tmp_path, [])).count() == 0


def test_files_are_validated_each_by_itself(spark, tmp_path):
    """Versions, ids and line numbers of a file; spaces of other scripts around a record; files without lines."""
    (tmp_path / "sets").mkdir()
    files = {
        "a.jsonl": [_example("x'y"), "\u00a0" + json.dumps(_example("z")) + "\u2003", _example("x'y"), _example("w", "v2")],
        "b.jsonl": ["\u2003", _example("w", "v2"), "{", _example("q", "v2", tags=["t"]), _example("r", "v1")],
        "c.jsonl": [_example("x'y", "v3", tags=["t", "u"])],
        "none.jsonl": [],
    }
    for name, lines in files.items():
        _file(tmp_path / "sets", [x if isinstance(x, str) else json.dumps(x) for x in lines], name)
    summary, findings, tags = datasets.validate_files(spark, str(tmp_path / "sets"))
    short = lambda f: f.rsplit("/", 1)[1]
    got = {short(r["file"]): (r["ok"], r["n_rows"], r["n_valid"], r["n_findings"], r["dataset_version"]) for r in summary.collect()}
    assert got == {"a.jsonl": (False, 4, 2, 2, "v1"), "b.jsonl": (False, 5, 2, 3, "v2"), "c.jsonl": (True, 1, 1, 0, "v3"), "none.jsonl": (False, 0, 0, 1, None)}
    rows = [(short(r["file"]), r["line_no"], r["code"], r["reason"]) for r in findings.collect()]
    assert rows[:-1] == [
        ("a.jsonl", 3, "duplicate_id", 'duplicate id "x\'y"; first seen at line 1; ids must be unique within a file'), ("a.jsonl", 4, "version_drift", "dataset_version 'v2' does not match file version 'v1'"),
        ("b.jsonl", 1, "parse", "blank line; dataset must have one JSON object per line"), ("b.jsonl", 3, "parse", "invalid JSON: Expecting property name enclosed in double quotes"),
        ("b.jsonl", 5, "version_drift", "dataset_version 'v1' does not match file version 'v2'"),
    ]
    assert rows[-1][:3] == ("none.jsonl", 0, "empty") and rows[-1][3].startswith("dataset file ") and rows[-1][3].endswith("none.jsonl contains no examples")
    assert [(short(r["file"]), r["tag"], r["count"]) for r in tags.collect()] == [("b.jsonl", "t", 1), ("c.jsonl", "t", 1), ("c.jsonl", "u", 1)]
    with pytest.raises(datasets.LoadError, match="more than one file"):
        datasets.load_golden(spark, str(tmp_path / "sets"))
    odd = _file(tmp_path, ["\u00a0" + json.dumps(_example("a"), ensure_ascii=False) + "\u001c"], "odd.jsonl")
    assert datasets.load_golden(spark, odd).first()["id"] == "a"
    assert datasets.validate_files(spark, _file(tmp_path, [json.dumps(_cal("a")), " ", ""], "cal.jsonl"), "calibration")[0].first()["n_findings"] == 2


def test_texts(spark, tmp_path):
    path = _file(tmp_path, ['"bare"', "", '{"prompt": "p", "input": 3}', '{"text": "t", "prompt": "q"}'])
    assert [(r["ord"], r["text"]) for r in datasets.load_texts(spark, path).orderBy("ord").collect()] == [(1, "bare"), (3, "p"), (4, "q")]
    path = _file(tmp_path, ['"a"\u2028"b"\x0b\x85"c"', '"d"'], "parted.jsonl")
    assert [(r["ord"], r["part"], r["text"]) for r in datasets.load_texts(spark, path).orderBy("ord", "part").collect()] == [(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "d")]
    with pytest.raises(ValueError, match="no texts"):
        datasets.load_texts(spark, _file(tmp_path, ["", " "], "blank.jsonl"))
    for line in ("3", '{"x": "y"}', "{"):
        with pytest.raises(Exception, match="bad.jsonl:1"):
            datasets.load_texts(spark, _file(tmp_path, [line], "bad.jsonl")).collect()


def test_run_history(spark, tmp_path):
    base = str(tmp_path / "db")
    rows = spark.createDataFrame([("a", 0.5, "x"), ("b", 1.0, None)], "example_id string, score double, reasoning string")
    history.write_run(rows, base, "r1", "2024-01-01T00:00:00Z", "s", "v1")
    history.write_run(rows.limit(1), base, "r2", "2024-01-02T00:00:00Z", "s", "v1")
    run, own = history.read_run(spark, base, "r1")
    assert (run.first()["mean_score"], run.first()["n_rows"], own.count()) == (0.75, 2, 2)
    with pytest.raises(ValueError, match="exists"):
        history.write_run(rows, base, "r1", "2024-01-01T00:00:00Z", "s", "v1")
    with pytest.raises(ValueError, match="repeated"):
        history.write_run(rows.union(rows), base, "r3", "2024-01-01T00:00:00Z", "s", "v1")
    with pytest.raises(KeyError):
        history.read_run(spark, base, "r3")
    assert history.runs(spark, base).count() == 2 and history.runs(spark, base + "x").count() == 0


def test_two_writers_of_a_run(spark, tmp_path):
    """Two threads write one run_id, held back until both have written their rows: one wins, no row of the other is seen."""
    import threading

    base, gate, seen = str(tmp_path / "db"), threading.Barrier(2), []
    real = commits.Log.commit

    def together(self, attempt, check):
        gate.wait(60)
        real(self, attempt, check)

    def write(score):
        rows = spark.createDataFrame([(f"{score}-{i}", score, "") for i in range(3)], "example_id string, score double, reasoning string")
        try:
            history.write_run(rows, base, "r", "t", "s", "v1")
            seen.append(("won", score))
        except ValueError as e:
            seen.append((str(e), score))

    commits.Log.commit = together
    try:
        threads = [threading.Thread(target=write, args=(x,)) for x in (0.25, 0.75)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
    finally:
        commits.Log.commit = real
    won = [s for what, s in seen if what == "won"]
    assert len(won) == 1 and sorted(what for what, _ in seen) == sorted(["won", "failed to persist run 'r': run_id exists"])
    run, own = history.read_run(spark, base, "r")
    assert run.first()["mean_score"] == won[0] and {r["score"] for r in own.collect()} == {won[0]} and history.rows(spark, base).count() == 3


def test_an_entry_of_the_log_has_one_writer(spark, tmp_path):
    import threading

    log, got = commits.Log(spark, str(tmp_path)), []
    gate = threading.Barrier(8)

    def claim(i):
        gate.wait(30)
        try:
            log.claim(0, f"a{i}")
            got.append(i)
        except commits.Taken:
            pass

    threads = [threading.Thread(target=claim, args=(i,)) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(got) == 1 and log.attempts() == [f"a{got[0]}"]
    log.local = None  # as on other file systems
    log.claim(1, "b")
    with pytest.raises(commits.Taken):
        log.claim(1, "c")
    assert log.attempts() == [f"a{got[0]}", "b"]


def test_a_folder_of_runs_is_one_commit(spark, tmp_path):
    """1000 run files, some bad, some with the same run_id, one that is there already."""
    base, folder = str(tmp_path / "db"), tmp_path / "runs"
    folder.mkdir()
    rows = spark.createDataFrame([("a", 0.5, "x")], "example_id string, score double, reasoning string")
    history.write_run(rows, base, "r00017", "t", "s", "v1")
    make = lambda i, **more: {"run_id": f"r{i:05d}", "started_at": f"t{i}", "suite": f"s{i % 3}", "mean_score": 0.5, "n_rows": 2, "rows": [{"example_id": "a", "score": 0}, {"example_id": "b", "score": i / 1000}]} | more
    bad = {5: {"mean_score": None}, 6: {"run_id": "r00007"}, 8: {"rows": [{"example_id": "a", "score": True}], "n_rows": 1}, 9: {"suite": None}, 10: {"started_at": ""}}
    for i in range(1000):
        (folder / f"{i:05d}.json").write_text(json.dumps(make(i, **bad.get(i, {}))) if i != 11 else "{")
    verdicts = {r["file"].rsplit("/", 1)[1]: r["reason"] for r in datasets.append_folder(spark, str(folder), base).collect()}
    assert len(verdicts) == 1000
    failed = {int(f[:5]): why for f, why in verdicts.items() if why}
    assert sorted(failed) == [5, 7, 8, 9, 10, 11, 17]
    for i, part in ((5, "mean_score must be a finite number; got None"), (7, "00006.json"), (8, "score must be a finite"), (9, "suite must be"), (10, "started_at must be"), (11, "JSONDecodeError"), (17, "'r00017': run_id exists")):
        assert part in failed[i]
    assert history.runs(spark, base).count() == 1000 - 7 + 1 and history.rows(spark, base).count() == 2 * (1000 - 7) + 1
    assert commits.Log(spark, base).attempts().__len__() == 2
    one, own = history.read_run(spark, base, "r00999")
    assert one.first()["started_at"] == "t999" and sorted(tuple(r) for r in own.collect()) == [("a", 0.0, "", "r00999"), ("b", 0.999, "", "r00999")]
    again = datasets.append_folder(spark, str(folder), base)
    assert again.where("reason is null").count() == 0 and len(commits.Log(spark, base).attempts()) == 2


def test_markdown_cells(spark):
    r = spark.createDataFrame([("a|b`c\r\nd",)], "t string").select(markdown.code_cell(F.col("t")).alias("c"), markdown.code_span(F.col("t")).alias("s")).first()
    assert (r["c"], r["s"]) == ("`a\\|b'c d`", "`a|b'c d`")


def test_run_files(spark, tmp_path):
    good = {"run_id": "r1", "started_at": "t", "suite": "s", "mean_score": 0.5, "n_rows": 2, "rows": [{"example_id": "a", "score": 0}, {"example_id": "b", "score": 1.0, "reasoning": "x"}]}
    path = lambda x: _file(tmp_path, [json.dumps(x, indent=2)], f"run{abs(hash(str(x)))}.json")
    one = datasets.load_run(spark, path(good))
    two = datasets.load_run(spark, path(good | {"run_id": "r2", "mean_score": 0.75, "rows": [{"example_id": "a", "score": 0.5}], "n_rows": 1}))
    assert one[0].first()["mean_score"] == 0.5 and sorted(map(tuple, one[1].collect())) == [("a", 0.0, "", "r1"), ("b", 1.0, "x", "r1")]
    rows, summary = runs.diff_runs(two, one)
    assert summary.first()["mean_delta"] == 0.25 and [r["status"] for r in rows.collect()] == ["improved", "removed"]
    row = good["rows"][0]
    bad = [[good], good | {"rows": 3}, good | {"rows": [3]}, good | {"rows": [row, row]}, good | {"n_rows": 3}, good | {"mean_score": float("nan")}, good | {"mean_score": True}, {k: v for k, v in good.items() if k != "mean_score"}, good | {"run_id": ""}, good | {"run_id": None}, good | {"suite": None}, {k: v for k, v in good.items() if k != "started_at"}]
    bad += [good | {"rows": [row | c], "n_rows": 1} for c in ({"example_id": None}, {"example_id": 3}, {"example_id": ""}, {"score": None}, {"score": True}, {"score": float("inf")}, {"score": []})]
    for x in bad:
        with pytest.raises(Exception, match="ValueError"):
            datasets.load_run(spark, path(x))


def _backends():
    """Judges for tests, local so that they travel to the workers by value; the first notes each question as a file."""

    class Shout:
        def __init__(self, folder=None):
            self.folder = folder

        def complete(self, system, user):
            if self.folder:
                import uuid

                open(f"{self.folder}/{uuid.uuid4().hex}", "w").close()
            return "SCORE: 0.9\nREASONING: said yes" if "yes" in user else "SCORE: 0.1\nREASONING: no"

    class Mute:
        def complete(self, system, user):
            return "I would rather not say"

    return Shout, Mute


def test_suite_run_from_file_to_history(spark, tmp_path):
    rows = [_example("a", tags=["x"], expected_outputs=[{"kind": "exact", "value": "yes"}]), _example("b", tags=["y"]), _example("c", tags=["x"])]
    golden = datasets.load_golden(spark, _file(tmp_path, list(map(json.dumps, rows))))
    base, asked = str(tmp_path / "db"), tmp_path / "asked"
    asked.mkdir()
    folder = str(asked)
    Shout, Mute = _backends()
    run, own = judging.run_suite(golden, lambda: Shout(folder), base, "r1", history.now(), "s")
    assert {r["example_id"]: (r["score"], r["reasoning"]) for r in own.collect()} == {"a": (0.9, "said yes"), "b": (0.1, "no"), "c": (0.1, "no")}
    assert run.first()["n_rows"] == 3 and run.first()["dataset_version"] == "v1" and len(list(asked.iterdir())) == 3
    answers = spark.createDataFrame([("a", "no"), ("c", "yes")], "id string, answer string")
    run2, own2 = judging.run_suite(golden, Shout, base, "r2", history.now(), "s", tags=["x"], answers=answers)
    assert {r["example_id"]: r["score"] for r in own2.collect()} == {"a": 0.1, "c": 0.9}
    diff, summary = runs.diff_runs((run2, own2), (run, own))
    assert summary.first()["n_flagged"] == 1 and summary.first()["n_removed"] == 1
    with pytest.raises(ValueError, match="there are"):
        judging.run_suite(golden, Shout, base, "r3", history.now(), "s", tags=["z"])
    with pytest.raises(Exception, match="no answer for example"):
        judging.score_suite(golden, Shout, answers=answers).collect()
    with pytest.raises(Exception, match="missing SCORE"):
        judging.score_suite(golden, Mute).collect()


def test_calibration_run(spark, tmp_path):
    cases = [_cal("a", 1.0, prompt="What is water", response="water is wet"), _cal("b", 0.0, prompt="Name rivers", response="none"), _cal("c", 0.0, prompt="colours", response="blank\n\nColours after a blank line"), _cal("d", 0.9, prompt="sky", response="blue")]
    rows = datasets.load_calibration(spark, _file(tmp_path, list(map(json.dumps, cases))))
    Shout, _ = _backends()
    judged, report = judging.calibrate(rows, judging.ByColumn(T.overlap_judge))
    assert [r["judge_score"] for r in judged.orderBy("id").collect()] == [0.85, 0.2, 0.2, 0.2]
    r = report.first()
    assert (r["n"], r["agreement"], r["kappa"], r["kappa_label"], r["status"]) == (4, 0.75, pytest.approx(0.5), "moderate", "FAIL")
    by_rubric = judging.calibrate(rows.withColumn("rubric", F.when(F.col("id") == "a", "yes").otherwise("r")), Shout, 0.4)
    assert [r["judge_score"] for r in by_rubric[0].orderBy("id").collect()] == [0.9, 0.1, 0.1, 0.1] and by_rubric[1].first()["status"] == "PASS"
    with pytest.raises(Exception, match="no rows"):
        judging.calibrate(rows.limit(0), Shout)[1].collect()
    with pytest.raises(ValueError):
        judging.calibrate(rows, Shout, float("nan"))


def test_ledger_asks_each_question_once_and_resumes(spark, tmp_path):
    """40 examples with 12 different questions; the judge breaks at one of them, then answers; then nothing is asked."""
    notes = tmp_path / "notes"
    notes.mkdir()

    def backend(broken):
        class Noting:
            def complete(self, system, user, folder=str(notes), broken=broken):
                import os
                import uuid

                if broken and "word7" in user:
                    raise RuntimeError("the judge is gone")
                with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
                    f.write(user)
                return f"SCORE: 0.{len(user) % 10}\nREASONING: said"

        return Noting

    rows = spark.createDataFrame([(f"e{i}", f"word{i % 12}", "a" * (i % 12)) for i in range(40)], "id string, input string, answer string").repartition(5)
    examples = rows.select("id", "input", F.array(F.struct(F.lit("exact").alias("kind"), F.col("answer").alias("value"))).alias("expected_outputs"), F.lit("v1").alias("dataset_version"), F.array().cast("array<string>").alias("tags"))
    ledger, base = judging.Ledger(str(tmp_path / "ledger"), "j"), str(tmp_path / "db")
    asked = lambda: sorted(p.read_text() for p in notes.iterdir())
    with pytest.raises(Exception, match="the judge is gone"):
        judging.run_suite(examples, backend(True), base, "r1", "t", "s", ledger=ledger)
    assert history.runs(spark, base).count() == 0
    stored = ledger.answers(spark).count()
    before = len(asked())
    run, own = judging.run_suite(examples, backend(False), base, "r1", "t", "s", ledger=ledger)
    # what was stored is not asked again: only what the broken block lost is, besides what was open
    assert len(asked()) - before == 12 - stored and len(set(asked())) == 12 and ledger.answers(spark).count() == 12
    assert run.first()["n_rows"] == 40 and own.where("score is null").count() == 0
    judging.run_suite(examples, backend(False), base, "r2", "t", "s", ledger=ledger)
    assert len(asked()) - before == 12 - stored
    judging.run_suite(examples, backend(False), base, "r3", "t", "s", ledger=judging.Ledger(ledger.folder, "another"))
    assert len(asked()) - before == 24 - stored


def test_patient_backends():
    class Status(Exception):
        def __init__(self, status_code):
            self.status_code = status_code

    class Failing:
        def __init__(self, *errors):
            self.errors = list(errors)

        def complete(self, system, user):
            if self.errors:
                raise self.errors.pop(0)
            return "said"

    waits = []
    ask = lambda *errors, **more: judging.Patient(Failing(*errors), sleep=waits.append, **more).complete("", "")
    assert ask(Status(429), ConnectionError(), TimeoutError()) == "said" and waits == [0.5, 1.0, 2.0]
    for errors in ([Status(400)], [ValueError()], [Status(503)] * 4):
        with pytest.raises(Exception):
            ask(*errors)
    waits.clear()
    assert ask(*[Status(529)] * 7, tries=8, most=4.0) == "said" and waits == [0.5, 1.0, 2.0, 4.0, 4.0, 4.0, 4.0]


def test_stub_judges(spark):
    asked = spark.createDataFrame([("say yes or no",), ("say no",), ("none",)], "t string")
    got = asked.select(T.needle_judge(F.col("t"), {"yes": 0.9, "no": 0.1}).alias("a"), T.needle_judge(F.col("t"), {"say": 0.3}, 0.8).alias("b"), T.constant_judge(0.7).alias("c"), T.length_judge(F.col("t")).alias("d")).collect()
    assert [tuple(r) for r in got] == [(0.9, 0.3, 0.7, 1 - 13 / 200), (0.1, 0.3, 0.7, 1 - 6 / 200), (0.1, 0.8, 0.7, 1 - 4 / 200)]


def test_validation_report(spark):
    df = lambda lines: spark.createDataFrame(list(enumerate(lines, 1)), "line_no long, line string")
    good, twice = json.dumps(_example("a", tags=["x", "x"])), json.dumps(_example("a", tags=["y"]))
    summary, findings, tags = validate.report(validate.outcomes(df([good, twice, json.dumps(_example("b", "v2")), ""])))
    assert tuple(summary.first()) == (False, 4, 1, 3, "v1") and [(r["tag"], r["count"]) for r in tags.collect()] == [("x", 2)]
    assert [tuple(r) for r in findings.collect()] == [(2, "duplicate_id", "duplicate id 'a'; first seen at line 1; ids must be unique within a file"), (3, "version_drift", "dataset_version 'v2' does not match file version 'v1'"), (4, "parse", "blank line; dataset must have one JSON object per line")]
    assert tuple(validate.report(validate.outcomes(df([good])))[0].first()) == (True, 1, 1, 0, "v1")
    empty = spark.createDataFrame([], "line_no long, line string")
    for found in (validate.outcomes(empty), validate.calibration_outcomes(empty)):
        summary, findings, _ = validate.report(found)
        assert tuple(summary.first()) == (False, 0, 0, 1, None) and [r["code"] for r in findings.collect()] == ["empty"]


def test_scratch_needs_a_shared_folder_and_is_cleared(spark):
    with scratch.scratch(spark):
        gone = scratch.written(spark.range(3))
        stays = scratch.kept(spark.range(4))
        assert gone.count() == 3
    assert stays.count() == 4
    with pytest.raises(Exception):
        gone.count()
