import duckdb
from pyspark.sql import functions as F

from alignspark.llm import licenses
from alignspark.llm.common import table


def scan(spark, rows, **more):
    df = spark.createDataFrame([(i, p, t, "x", 0.1) for i, (p, t) in enumerate(rows)], "n int, path string, text string, license string, score double")
    return {rows[r.n][0] or r.n: r for r in licenses.scan(df, "n", F.col("path"), **more).collect()}


def test_headers_files_and_inheritance(spark):
    got = scan(spark, [
        ("a/LICENSE", "Released under the MIT License.\n" + "word " * 50),
        ("a/x.py", "code code code"),
        ("a/b/y.py", "Some text. Licensed under the Apache License, Version 2.0. " + "more " * 30),
        ("a/b/z.py", None),
        ("a/c/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        ("a/c/d/e/f.py", ""),
        ("a/c/g.py", "license to thrill"),
        ("q/r/s.py", "nothing"),
        ("top.py", "nothing"),
        (None, "Licensed under CC BY-NC 4.0"),
        ("q/whole", "licensed under cc by 4.0"),
        ("q/r/t.py", "x " * 50_000),
    ])
    show = {k: (r.license, r.origin, r.inherited_from) for k, r in got.items()}
    assert show == {
        "a/LICENSE": ("MIT", "file", None), "a/x.py": ("MIT", "inherited", "a"), "a/b/y.py": ("Apache-2.0", "header", None),
        "a/b/z.py": ("MIT", "inherited", "a"), "a/c/COPYING.txt": ("GPL-3.0", "file", None), "a/c/d/e/f.py": ("GPL-3.0", "inherited", "a/c"),
        "a/c/g.py": ("GPL-3.0", "inherited", "a/c"), "q/r/s.py": ("CC-BY-4.0", "inherited", "q"), "top.py": (None, "none", None),
        9: ("CC-BY-NC-4.0", "file", None), "q/whole": ("CC-BY-4.0", "file", None), "q/r/t.py": ("CC-BY-4.0", "inherited", "q"),
    }
    assert got["a/LICENSE"].score == 1.0


def test_every_template_finds_its_licence(spark):
    got = scan(spark, [(f"d{i}/x", "before.\n" + b + "\nafter " * 9) for i, (_, b) in enumerate(licenses.TEMPLATES)])
    assert [got[f"d{i}/x"].license for i in range(len(licenses.TEMPLATES))] == [a for a, _ in licenses.TEMPLATES]


def test_whole_texts_and_notices_in_files(spark):
    filled = lambda t: t.replace("<year>", "2021").replace("<copyright holders>", "Jane Doe. All rights reserved.")
    whole = [(f"w{i}/LICENSE", filled(t)) for i, (_, t) in enumerate(licenses._texts())]
    commented = [(f"c{i}/main.c", "/*\n * " + filled(t).replace("\n", "\n * ") + "\n */\n\nint main(void) { return twice(thrice(once)); }\n" + "static int f(int x) { return x; }\n" * 40) for i, (name, t) in enumerate(licenses._texts()) if name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause")]
    got = scan(spark, whole + commented + [("p/x.c", "Copyright 2020 Foo Inc. All rights reserved.\n\nint x;\n" * 1 + "int y;\n" * 30)])
    for i, (name, _) in enumerate(licenses._texts()):
        assert (got[f"w{i}/LICENSE"].license, got[f"w{i}/LICENSE"].origin) == (name, "file")
        if f"c{i}/main.c" in got:
            assert (got[f"c{i}/main.c"].license, got[f"c{i}/main.c"].origin) == (name, "header")
    assert got["p/x.c"].license == "proprietary"


def test_a_null_id_keeps_its_header(spark):
    df = spark.createDataFrame([(None, "a/b", "Released under the MIT License"), (None, "a/c", "nothing here"), (1, "q/b", "nothing here")], "n int, path string, text string")
    assert sorted(str(r.license) for r in licenses.scan(df, "n", F.col("path")).collect()) == ["MIT", "MIT", "None"]  # a/c inherits


def test_empty_table_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, "a/b", "MIT License"), (1, "a/b", "MIT License")], "n int, path string, text string")
    assert licenses.scan(df, "n", F.col("path")).count() == 2
    assert licenses.scan(df.limit(0), "n", F.col("path")).count() == 0


def test_sql(spark, sf):
    sf = sf.replace("0.001", "0.01")
    got = licenses.scan(table(spark, sf, "documents"), "doc_id", licenses.document_path()).collect()
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.execute(licenses.oracle()).fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert sum(r.origin == "header" for r in got) > 10
