from quillstone.llm import license_scan as L


def test_inherits_from_the_nearest_directory(spark):
    mit, apache = "Released under the MIT License.", "x\nLicensed under the Apache License, Version 2.0.\nmore words"
    rows = [
        ("a/LICENSE", mit, True), ("a/x.py", "code", False), ("a/b/y.py", "code", False), ("a/b/c/LICENSE", apache, True),
        ("a/b/c/d/z.py", None, False), ("a/own.py", "text\r\n" * 500 + apache, False), ("e/f.py", "no licence here", False),
        ("top.py", "", False), (None, mit, True), ("a/x.py", "code", False), ("a/b/c/ZLICENSE", mit, True),
    ]
    got = sorted(map(tuple, L.scanned(spark.createDataFrame([(*r, 1) for r in rows], "path string, text string, is_notice boolean, license int")).collect()), key=repr)
    kinds = {r[0]: (r[1], r[3], r[4]) for r in got}
    assert len(got) == len(rows)
    assert kinds["a/x.py"] == kinds["a/b/y.py"] == ("MIT", "inherited", "a/LICENSE")
    assert kinds["a/own.py"] == ("Apache-2.0", "own", "a/own.py")
    assert kinds["a/b/c/d/z.py"][1] == "inherited" and kinds["a/b/c/d/z.py"][0] in ("Apache-2.0", "MIT")
    assert kinds["e/f.py"] == kinds["top.py"] == (None, None, None)


def test_no_rows(spark):
    assert L.scanned(spark.createDataFrame([], "path string, text string, is_notice boolean")).count() == 0


def test_against_sql(spark):
    """The query's SQL on a sample, and on odd rows."""
    import os

    import duckdb

    where = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{where}/documents.parquet'" if os.path.isfile(f"{where}/documents.parquet") else f"create view documents as select * from '{where}/documents.parquet/*.parquet'")
    want = con.execute(L.ORACLE_SQL).fetchall()
    got = [tuple(r) for r in L.op3_license_scan(spark, where).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and any(r[2] for r in got)


def test_notices_without_cue_words(spark):
    rows = [("a", "x\nCC BY-NC 4.0"), ("b", "Apache Version 2.0"), ("c", "Mit."), ("d", "Mit und."), ("e", "the license of this"), ("f", "Released under the MIT License" + " word" * 100_000), ("g", "MIT License")]
    got = {r.path: r.license for r in L.notices(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"a": "CC-BY-NC-4.0", "b": "Apache-2.0", "f": "MIT", "g": "MIT"}  # terms count once a line


def test_no_line_without_a_telling_term_reaches_the_least(spark):
    terms = {t for v in L.TEMPLATES.values() for t in v.lower().replace(",", "").split()}
    rest = sorted(terms - set(L.telling(L.TEMPLATES, L.LEAST)))
    rows = [(str(i), " ".join(w for k, w in enumerate(rest) if i >> k & 1)) for i in range(1, 1 << len(rest))][: 1 << 12]
    assert rest and L.notices(spark.createDataFrame(rows, "path string, text string")).count() == 0


def test_ties_and_repeats(spark):
    rows = [("a/x", "Licensed under CC BY 4.0", False), ("a/y", "MIT License", True), ("a/y", "MIT License", True), ("a/z", None, False)]
    got = sorted(map(tuple, L.scanned(spark.createDataFrame([(*r, "k") for r in rows], "path string, text string, is_notice boolean, term string")).collect()), key=repr)
    assert len(got) == 4
    assert got[-1][0] == "a/z" and got[-1][3] == "inherited"
    tied = L.notices(spark.createDataFrame([("p", "one two")], "path string, text string"), templates={"B": "one two three", "A": "one two four"}).collect()
    assert [r.license for r in tied] == ["A"]
