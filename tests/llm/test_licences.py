import textwrap
from pathlib import Path

import duckdb

from shoebox.llm import common as c
from shoebox.llm.licence_texts import DIGESTS, LICENCES, NOTICES, TITLES
from shoebox.llm.licences import NOTICE_MARKS, licence_scan, licence_sql


def test_equals_sql(spark, sf):
    got = licence_scan(c.documents(spark, sf)).collect()
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, got), key=str) == sorted(db.execute(licence_sql()).fetchall(), key=str)
    assert sum(r.n_notices for r in got) > 0


def test_variants(spark):
    mit = LICENCES["MIT"]
    texts = [
        mit,
        "MIT License body\n" + mit,
        "Copyright (c) 2019 Some One <a@b.c>\n\n" + mit.replace(", ", " , ").upper(),
        "/* Copyright 2001-2003, X\n * © Y */\n".replace("/*", " ").replace("*/", "") + mit.replace("\n\n", "\r\n"),
        LICENCES["Apache-2.0"].replace("License", "Licence").replace("http://", "https://"),
        LICENCES["BSD-2-Clause"] + "\nAll rights reserved.",
        "all RIGHTS reserved",
        "text\nReleased under the MIT Licence!\nmore\nAll rights reserved.",
        None,
        "",
    ]
    got = {r.doc_id: r for r in licence_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert [got[k].licence for k in range(10)] == ["MIT", None, "MIT", "MIT", "Apache-2.0", "BSD-2-Clause", "all-rights-reserved", None, None, None]
    assert got[7].notices == "MIT,all-rights-reserved" and got[7].n_notices == 2 and got[8].canonical_sha256 == got[9].canonical_sha256


def test_every_known_text_in_its_published_form(spark):
    """Bare, and under a title and a copyright line; and the full texts that Unix systems bring along."""
    texts = [(k, f"{title}\n\nCopyright (c) 2024 Some One\n\n{t}\n") for k, t in LICENCES.items() for title in ("", *TITLES.get(k, ()))]
    wrapped = [(k, "\n\n".join(textwrap.fill(x, 78) for x in t.split("\n\n"))) for k, t in texts]
    files = {"GPL-1": "GPL-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2": "LGPL-2.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "Artistic": "Artistic-1.0-Perl"}
    files |= {k: k for k in ("Apache-2.0", "CC0-1.0", "GFDL-1.2", "GFDL-1.3", "MPL-1.1", "MPL-2.0")}
    shipped = [(k, path.read_text("utf-8", "replace")) for f, k in files.items() if (path := Path("/usr/share/common-licenses", f)).is_file()]
    shipped += [(k, t[: t.index("END OF TERMS AND CONDITIONS") + 27]) for k, t in shipped if k in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "Apache-2.0")]
    want = wrapped + shipped
    got = {r.doc_id: r.licence for r in licence_scan(spark.createDataFrame([(k, t) for k, (_, t) in enumerate(want)], "doc_id long, text string")).collect()}
    assert [got[k] for k in range(len(want))] == [k for k, _ in want]
    assert len(set(DIGESTS.values())) >= 17 and all(len(d) == 64 for d in DIGESTS)


def test_odd_rows(odd_docs, no_docs):
    assert licence_scan(odd_docs).count() == odd_docs.count() and licence_scan(no_docs).collect() == []


def test_marks_are_in_every_notice():
    assert all(any(m in text.lower() for m in NOTICE_MARKS) for _, text in NOTICES)
