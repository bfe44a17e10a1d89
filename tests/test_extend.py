import random

import pytest
from pyspark.sql import functions as F

from veldra.operators import extend, pick
from veldra.sources import logs


def test_expander_in_a_lateral_join_and_in_sql(spark):
    letters = extend.Expander("pos int, letter string", lambda t: enumerate(t or ""))
    df = spark.createDataFrame([(1, "ab"), (2, ""), (3, None)], "id int, t string")
    assert sorted(tuple(r) for r in letters.over(df, F.col("t")).select("id", "pos", "letter").collect()) == [(1, 0, "a"), (1, 1, "b")]
    assert sorted(((r.id, r.letter) for r in letters.over(df, F.col("t"), outer=True).collect()), key=str) == [(1, "a"), (1, "b"), (2, None), (3, None)]
    letters.register(spark, "letters")
    df.createOrReplaceTempView("words_of_a_test")
    assert spark.sql("SELECT id, letter FROM words_of_a_test w, LATERAL letters(w.t) WHERE letter = 'b'").collect()[0].id == 1


def test_sections(spark):
    html = '<title>T &amp; x</title><h1></h1><p>one <b>two</b></p><script type="application/ld+json">[{"b":1},2,{"a":"é"}]</script><script type="application/ld+json">bad</script>'
    df = spark.createDataFrame([(html,), (None,)], "html string")
    rows = [(r.pos, r.kind, r.text) for r in extend.SECTIONS.over(df, F.col("html")).collect()]
    assert rows == [(0, "title", "T & x"), (1, "p", "one two"), (2, "json", '{"b": 1}'), (3, "json", '{"a": "é"}')]


@pytest.mark.parametrize("rows", [3, 40, 50_000])
def test_fold_is_the_native_merge(spark, rows):
    r = random.Random(4)
    some = [(r.choice(["hot", "hot", "hot", "b", None]), r.choice([None, "", "x", "y"]), r.choice([None, 1.5, 2.5]), r.choice([None, True, False]), k) for k in range(300)]
    df = spark.createDataFrame(some, "k string, name string, pay double, flag boolean, seq long").repartition(6)
    fold = extend.results_fold(["name"], ["pay"], ["flag"])
    got = extend.Fold(fold.lift, fold.combine, fold.finish, rows).over(df, ["k"])
    want = pick.merge_results(df, ["k"], ["name"], ["pay"], ["flag"], [])
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert fold.over(df.limit(0), ["k"]).count() == 0


def test_a_fold_sends_states_not_rows(spark):
    df = spark.range(40_000, numPartitions=4).select((F.col("id") % 2).alias("k"), F.lit("a").alias("name"), F.col("id").alias("seq"))
    fold = extend.results_fold(["name"], [], [])
    states = df.select("k", *(c.alias(n) for n, c in fold.lift.items()))
    combine, columns = fold.combine, states.columns
    sent = states.mapInPandas(lambda bs: (combine(b, ["k"])[columns] for b in bs), states.schema).count()
    assert sent <= 2 * 8 and {r.merged for r in fold.over(df, ["k"]).collect()} == {20_000}


LINES = ["u1\t2026-01-01\tp\tT\tAcme\tadded", "", "u2\t2026-01-02\tp\té日本\tB\tskipped\tRome\tfp\t2026-01-01\textra", "u3"]


@pytest.mark.parametrize("split", ["1", "7", "40", str(logs.SPLIT)])
@pytest.mark.parametrize("end", ["", "\n", "\r\n"])
def test_history_in_ranges_of_any_size(spark, tmp_path, split, end):
    (tmp_path / "a.tsv").write_text("\n".join(LINES) + end, encoding="utf-8", newline="")
    (tmp_path / "b.tsv").write_text("u9\n")
    (tmp_path / "_SUCCESS").write_text("u0\n")
    (tmp_path / "empty").write_text("")
    rows = logs.read_log(spark, f"file://{tmp_path}", "history", int(split)).collect()
    assert sorted(r.url for r in rows) == ["u1", "u2", "u3", "u9"]
    two = next(r for r in rows if r.url == "u2")
    assert tuple(two) == ("u2", "2026-01-02", "p", "é日本", "B", "skipped", "Rome", "fp", "2026-01-01")


def test_filters_on_equality_are_taken_over(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("\n".join(LINES) + "\n", encoding="utf-8")
    df = logs.read_log(spark, str(tmp_path), "history").where((F.col("status") == "added") & F.col("url").startswith("u"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    # Spark doesn't filter by it again
    assert "StartsWith(url" in plan and "= added" not in plan
    assert [r.url for r in df.collect()] == ["u1"]
    reader = logs.LogReader("history", {"path": "x"}, df.schema)
    from pyspark.sql.datasource import EqualTo, GreaterThan

    kept = [EqualTo(("status",), None), GreaterThan(("url",), "a")]
    assert list(reader.pushFilters([EqualTo(("status",), "added"), *kept])) == kept and reader.wanted == [(5, "added")]


def test_stream_reads_whole_lines_and_what_is_appended(spark, tmp_path):
    folder, out, at = tmp_path / "in", tmp_path / "out", tmp_path / "at"
    folder.mkdir()

    def run():
        logs.stream_log(spark, str(folder), "pending").writeStream.format("parquet").option("path", str(out)).option("checkpointLocation", str(at)).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema(logs.SCHEMAS["pending"]).parquet(str(out)).collect())

    (folder / "a.md").write_text("# head\n- [ ] u1 | A | T\n- [x] u0 | A | T\n- [ ] u2 | B")
    assert run() == [("u1", "A", "T")]
    with (folder / "a.md").open("a") as f:
        f.write(" | T2 | more\n- [ ] u3")
    (folder / "b.md").write_text("- [ ] u4 | C | T4\n")
    assert run() == [("u1", "A", "T"), ("u2", "B", "T2"), ("u4", "C", "T4")]
    assert len(run()) == 3


def test_trackers_have_their_own_columns(spark, tmp_path):
    (tmp_path / "new.md").write_text("text\n| # | Company | Role | Score | Status |\n|---|---|---|---|---|\n| 7 | Acme | Dev | applied | **4.5/5** |\n| x | bad | row | 1/5 | s |\n")
    (tmp_path / "old.md").write_text("| 8 | 2026-01-01 | B | Ops | 3/5 | open | p | r | n |\n")
    rows = sorted(logs.read_log(spark, str(tmp_path), "tracker").collect())
    assert [(r.num, r.date, r.company, r.role, r.score, r.status, r.notes) for r in rows] == [(7, "", "Acme", "Dev", "**4.5/5**", "applied", ""), (8, "2026-01-01", "B", "Ops", "3/5", "open", "n")]


def test_unknown_kind(spark, tmp_path):
    with pytest.raises(Exception, match="kind must be one of"):
        logs.read_log(spark, str(tmp_path), "other").collect()
