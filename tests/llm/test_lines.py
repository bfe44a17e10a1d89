from collections import Counter

from veldra.llm import lines


def brute(rows, ratio, least):
    pages = Counter(host for _, _, host in rows)
    seen = Counter((host, x) for _, t, host in rows for x in {y.strip(" ") for y in (t or "").split("\n")} if x)
    bad = {k for k, n in seen.items() if n >= least and n > ratio * pages[k[0]]}
    return [(i, None if t is None else "\n".join(x for x in t.split("\n") if (h, x.strip(" ")) not in bad)) for i, t, h in rows]


def test_against_brute_force(spark):
    rows = [(i, f"menu\nbody {i}\n\n footer \nbody {i % 7}", "a" if i % 3 else "b") for i in range(60)]
    rows += [(100 + i, "menu\nmenu\nx", None) for i in range(4)] + [(200, None, "a"), (201, "", "a"), (202, "menu", "c"), (202, "menu", "c")]
    docs = spark.createDataFrame([(*r, "keep") for r in rows], "doc_id long, text string, source string, _dropped string")
    for ratio, least in ((0.05, 3), (0.5, 2), (0.2, 5)):
        got = lines.drop_boilerplate(docs, ratio=ratio, min_pages=least)
        assert got.columns == ["doc_id", "text", "source", "_dropped"]
        assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted(brute(rows, ratio, least), key=str)


def test_clashing_names(spark):
    rows = [(i, f"menu\nbody {i}", "a", "1", "2", "3", "4") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _host string, _LINES string, _bad string, _common string")
    got = lines.clean_documents(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.collect()) == [(i, f"body {i}", "a", "1", "2", "3", "4") for i in range(9)]


def test_query_and_sql_agree_on_nulls_and_repeated_rows(spark):
    import duckdb

    rows = [(i % 7, f"menu\nbody {i}\n\n menu ", "a") for i in range(20)] + [(30, None, "a"), (30, None, None), (31, "", None), (32, "menu", None), (32, "menu", None), (32, "menu", None)]
    got = lines.dedup(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    db = duckdb.connect()
    db.execute("CREATE TABLE documents(doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert sorted((tuple(r) for r in got), key=str) == sorted(db.execute(lines.ORACLE).fetchall(), key=str)


def test_no_python_in_the_plan(spark, odd):
    plan = lines.clean_documents(odd)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_odd_rows(odd, none):
    got = lines.clean_documents(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    assert lines.clean_documents(none).count() == 0
    assert lines.dedup(odd).count() == odd.count()
