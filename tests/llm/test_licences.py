from pathlib import Path

from tidepack.llm import licences as module
from tidepack.llm.licences import KNOWN, licences

MIT = next(t for n, t in KNOWN if t.startswith("MIT License"))


def test_licences(spark):
    words = MIT.split()
    wrapped = "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)).upper().replace("MIT LICENSE", "M.I.T. Licence".replace("M.I.T.", "MIT") + "\n\nCopyright (c) 2020 Someone, Inc.\nAll rights reserved.\n")
    rows = [
        (1, MIT, 0),
        (2, wrapped, 0),
        (3, MIT + " And more.", 0),
        (4, "text\nreleased under the MIT licence\nLicensed under CC BY-NC 4.0!\nmore", 0),
        (5, None, 0),
        (6, " .. \n", 0),
        (7, "no licence here", 0),
        (7, "no licence here", 0),
        (8, "intro\n\n" + "\n".join(" ".join(words[i : i + 9]) for i in range(0, len(words), 9)) + "\n\noutro", 0),
        (9, "word " * 200_000, 0),
    ]
    got = licences(spark.createDataFrame(rows, "doc_id long, text string, digest int")).collect()
    assert sorted((r.doc_id, r.whole_licence, r.licences) for r in got) == [
        (1, "MIT", "MIT"),
        (2, "MIT", "MIT"),
        (3, None, ""),
        (4, None, "CC-BY-NC-4.0,MIT"),
        (5, None, ""),
        (6, None, ""),
        (7, None, ""),
        (7, None, ""),
        (8, None, "MIT"),
        (9, None, ""),
    ]
    assert {r.doc_id: r.digest is None for r in got}[5] and {r.doc_id: r.digest is None for r in got}[6]
    assert licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_entire_texts_with_and_without_title(spark):
    folder = Path(module.__file__).parent / "licence_texts"
    rows, want = [], {}
    for path in sorted(folder.glob("*.txt")):
        text = path.read_text("utf-8")
        for t in (text, text.upper() + "\n\n"):
            rows.append((len(rows), t))
            want[rows[-1][0]] = path.stem
    bsd = next(t for n, t in KNOWN if n == "BSD-3-Clause")
    for name, t in (("MIT", MIT.removeprefix("MIT License ")), ("BSD-3-Clause", bsd), ("Apache-2.0", (folder / "Apache-2.0.txt").read_text().split("APPENDIX")[0])):
        rows.append((len(rows), t))
        want[rows[-1][0]] = name
    got = {r.doc_id: r.whole_licence for r in licences(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0", "Unlicense"} <= set(want.values())


def test_null_ids_clashing_columns_and_many_hits(spark):
    lines = "\n".join(["Released under the MIT License.", "Licensed under CC BY 4.0."] * 3000)
    rows = [(None, MIT, 7, "x"), (None, MIT, 7, "x"), (None, None, None, None), (1, lines, 1, "y"), (1, "Released under the MIT License.", 1, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row int, licence string").selectExpr("*", "licence as part", "row as place", "licence as known_digest")
    got = licences(docs)
    assert got.columns == ["doc_id", "digest", "whole_licence", "licences"]
    assert sorted((r.doc_id or 0, r.whole_licence or "", r.licences) for r in got.collect()) == [(0, "", ""), (0, "MIT", "MIT"), (0, "MIT", "MIT"), (1, "", "CC-BY-4.0,MIT"), (1, "MIT", "MIT")]
