from driftfield.llm import licences as L


def test_spellings_case_and_copyright_lines_make_no_difference(spark):
    mit = next(t for n, k, t in L.KNOWN if (n, k) == ("MIT", "text"))
    docs = spark.createDataFrame(
        [
            (1, mit), (2, "Copyright (c) 2020 A. Person\n\n" + mit.upper().replace(",", " ;") + "\n"), (3, mit.replace("\n", "\r\n").replace("sublicense", "sublicence")),
            (4, mit + " more"), (5, "Some words.\nreleased   under the M.I.T licence\nReleased under the MIT LICENCE!\nAll Rights Reserved\n"), (6, None), (7, "© me"),
            (8, "Licensed under the Apache License, v2.0."), (8, "Licensed under the Apache License, v2.0."),
        ],
        "doc_id bigint, text string",
    )
    got = sorted((r["doc_id"], r["licence"], r["notices"], r["n_notices"]) for r in L.scan(docs).fillna("", "licence").collect())
    assert got[:5] == [(1, "MIT", "", 0), (2, "MIT", "", 0), (3, "MIT", "", 0), (4, "", "", 0), (5, "", "MIT,proprietary", 2)]
    assert got[5:7] == [(6, "", "", 0), (7, "", "", 0)]
    assert len({r["text_digest"] for r in L.scan(docs.where("doc_id < 4")).collect()}) == 1
    assert got[7] == got[8]


def test_every_known_text_finds_itself(spark):
    docs = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(L.KNOWN)], "doc_id bigint, text string")
    assert {r["doc_id"]: r["licence"] for r in L.scan(docs).collect()} == {i: n for i, (n, _, _) in enumerate(L.KNOWN)}


def test_edges(edge_docs, no_docs):
    rows = L.scan(edge_docs).collect()
    assert len(rows) == edge_docs.count() and not any(r["licence"] or r["n_notices"] for r in rows)
    assert L.scan(no_docs).collect() == []
    assert len(L.scan(edge_docs, known=()).collect()) == edge_docs.count()


def test_known_texts_come_from_a_table(spark):
    """Entire texts with and without their title line, and identifier lines, are found once a table holds them."""
    mit = next(t for n, k, t in L.KNOWN if (n, k) == ("MIT", "text"))
    unlicense = "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy it."
    known = spark.createDataFrame([*L.KNOWN, ("MIT", "text", "MIT License\n\n" + mit), ("Unlicense", "text", unlicense), ("MIT", "notice", "SPDX-License-Identifier: MIT")], "licence string, kind string, text string")
    docs = spark.createDataFrame([(1, "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + mit), (2, mit), (3, unlicense.upper()), (4, "// SPDX-License-Identifier: MIT\nint main;")], "doc_id bigint, text string")
    got = {r["doc_id"]: (r["licence"], r["notices"]) for r in L.scan(docs, known).collect()}
    assert (got[1][0], got[2][0], got[3][0], got[4]) == ("MIT", "MIT", "Unlicense", (None, "MIT"))
    assert len(L.scan(docs, known.where("false")).collect()) == 4
