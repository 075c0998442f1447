import math
import os
import re
from collections import Counter

from pyspark.sql import functions as F

from docscore.llm import licenses as op


def words(text):
    return "".join(" " if c in op.SIGNS else c for c in text.lower()).split()


def brute(texts):
    """(license, cosine, n_matches) of each text, without inheritance; every unit against every template."""
    vectors = [(name, Counter(words(line))) for name, lines in op.TEMPLATES.items() for line in lines]
    have = [set(words(t or "")) for t in texts]
    idf = {t: 1 + math.log((len(texts) + 1) / (sum(t in w for w in have) + 1)) for _, v in vectors for t in v}
    unknown = 1 + math.log(len(texts) + 1)
    size = lambda tf: math.sqrt(sum((c * idf.get(t, unknown)) ** 2 for t, c in tf.items()))
    leader, other = (re.compile(x.replace("(?dm)", "(?m)")) for x in (op.LEADER, op.NOT_COMMENT))
    out = []
    for text in texts:
        low = (text or "").lower()
        bare = leader.sub("", low)
        parts = re.split(op.SEGMENT, bare)
        said = [" ".join(words(s)) for s in parts]
        blocks = {" ".join(words(s)) for s in re.split(op.BLOCK, bare)}
        if leader.search(low):
            blocks |= {" ".join(words(s)) for s in re.split(op.BLOCK, leader.sub("", other.sub("", low)))}
        blocks -= set(said)
        file = {" ".join(words(bare))} - set(said) - blocks
        found = []
        for place, unit in [(2, x) for x in said if x] + [(1, x) for x in blocks if x] + [(0, x) for x in file if x]:
            tf = Counter(unit.split())
            cosines = [(sum(c * tf[t] * idf[t] ** 2 for t, c in v.items()) / size(v) / size(tf), name) for name, v in vectors]
            best = [(place, -round(cosine, 6), name) for cosine, name in cosines if cosine >= op.THRESHOLD - op.SLACK]
            found += [min(best)] if best else []
        out.append((min(found)[2], -min(found)[1], len(found)) if found else (None, 0.0, 0))
    return out


def compared(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    # a folder for each document: nothing is inherited
    got = {r["doc_id"]: r for r in op.scan(docs, F.concat(F.col("doc_id").cast("string"), F.lit("/x"))).collect()}
    for k, (licence, cosine, n) in enumerate(brute(texts)):
        assert (got[k]["license"], got[k]["n_matches"]) == (licence, n), texts[k]
        assert abs(got[k]["cosine"] - cosine) < 2e-6
    return [got[k]["license"] for k in range(len(texts))]


def test_fixture_matches_brute_force(spark):
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    assert any(compared(spark, texts))


def wrap(text, width, lead):
    lines, line = [], ""
    for word in text.split():
        if len(line) + len(word) > width:
            lines, line = [*lines, line], ""
        line = f"{line} {word}".strip()
    return "\n".join(lead + x for x in [*lines, line])


def test_wrapped_headers_and_whole_files(spark):
    t, apache = op.TEMPLATES, "http://www.apache.org/licenses/LICENSE-2.0"
    head = f"{t['Apache-2.0'][3]}\n\n    {apache}\n\n" + t["Apache-2.0"][5].split(apache)[1].strip()
    code = "\nimport os\n\n\ndef main(path):\n    return os.listdir(path)\n" * 5
    paragraphs = lambda text, ends: "\n\n".join(wrap(x, 70, "") for x in re.split(ends, text))
    whole = [
        ("GPL-3.0", "/*\n" + wrap(t["GPL-3.0"][4], 60, " * ") + "\n */\n" + code),
        ("GPL-3.0", wrap(t["GPL-3.0"][2], 50, "# ") + code),
        ("Apache-2.0", "\n".join("// " + x for x in wrap(t["Apache-2.0"][3], 70, "").split("\n")) + "\n//\n//     " + apache + code),
        ("Apache-2.0", "#!/bin/sh\n" + wrap(head, 72, "# ") + code),
        ("MPL-2.0", wrap(t["MPL-2.0"][2], 66, "-- ") + "\n" + code),
        ("MIT", "MIT License\n\nCopyright (c) 2020 Some Body\n\n" + paragraphs(t["MIT"][6], r"(?<=conditions:) |(?<=Software\.) ")),
        ("BSD-3-Clause", "Copyright 2019, Some Body\nAll of it.\n\n" + paragraphs(t["BSD-3-Clause"][4], r"(?<=met:) | (?=\d\. )|(?<=permission\.) ")),
        ("BSD-2-Clause", "Copyright 2019, Some Body\n\n" + paragraphs(t["BSD-2-Clause"][2], r"(?<=met:) | (?=\d\. )|(?<=distribution\.) ")),
        ("ISC", "ISC\n\n" + paragraphs(t["ISC"][2], r"(?<=copies\.) ")),
        ("GPL-3.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n" + "The licences for most works are designed to take away your freedom. " * 40),
        (None, code), (None, ""), (None, None), (None, "word " * 30_000), (None, "// " + "\n// ".join(f"a comment of line {k} about the software" for k in range(300))),
    ]
    plain = [f"ordinary text number {k} about rivers, towns and the weather of the year" for k in range(60)]
    found = compared(spark, [text for _, text in whole] + plain)
    assert found[: len(whole)] == [name for name, _ in whole]


def test_whole_licence_files_of_the_system(spark):
    folder = "/usr/share/common-licenses"
    names = {k: v for k, v in {"GPL-3.0": "GPL-3", "Apache-2.0": "Apache-2.0", "MPL-2.0": "MPL-2.0"}.items() if os.path.exists(f"{folder}/{v}")}
    templates = op.with_files(folder, names)
    texts = [(k, open(f"{folder}/{v}", encoding="utf-8").read().upper().replace("\n", "\n// ")) for k, v in names.items()]
    docs = spark.createDataFrame([(i, f"d{i}/src/{i}", x) for i, (_, x) in enumerate(texts)] + [(100 + i, f"d{i}/a/b", "plain") for i in range(len(texts))] + [(99, "z", "")], "doc_id long, path string, text string")
    got = {r["doc_id"]: r for r in op.scan(docs, F.concat(F.lit("/"), F.regexp_replace("path", "/src", "")), templates=templates).collect()}
    for i, (name, _) in enumerate(texts):
        assert (got[i]["license"], got[i]["basis"]) == (name, "own") and got[i]["cosine"] > 0.95
        assert (got[100 + i]["license"], got[100 + i]["basis"]) == (name, "inherited")


def test_headers_and_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Apache License\nLicensed under the Apache License, Version 2.0.\n" + "other words here. " * 50),
        (2, "a/b/c/code.txt", "no terms"),
        (3, "a/b/notes.txt", "Released under the MIT License."),
        (4, "a/b/deep/er/x.txt", "plain"),
        (5, "z/x.txt", None),
        (6, "COPYING.md", "licensed under cc by-nc 4.0."),
        (7, None, ""),
        (7, None, ""),
        (None, "a/own.txt", "text text text. this WORK is licensed under the GNU General Public License, version 3. more text of the file follows here"),
        (8, "a/long.txt", "All rights are good. " * 20_000),
        (9, "b/one.txt", "all rights reserved"),
        (10, "b/two.txt", "license license license"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, path string, text string").withColumns({"row": F.lit(1), "license": F.lit("x")})
    got = {(r["doc_id"], r["path"]): (r["license"], r["basis"], r["inherited_from"]) for r in op.scan(docs, F.col("path")).collect()}
    assert got == {
        (1, "a/LICENSE"): ("Apache-2.0", "own", None),
        (2, "a/b/c/code.txt"): ("MIT", "inherited", "a/b"),
        (3, "a/b/notes.txt"): ("MIT", "own", None),
        (4, "a/b/deep/er/x.txt"): ("MIT", "inherited", "a/b"),
        (5, "z/x.txt"): ("CC-BY-NC-4.0", "inherited", ""),
        (6, "COPYING.md"): ("CC-BY-NC-4.0", "own", None),
        (7, ""): ("CC-BY-NC-4.0", "inherited", ""),
        (None, "a/own.txt"): ("GPL-3.0", "own", None),
        (8, "a/long.txt"): ("Apache-2.0", "inherited", "a"),
        (9, "b/one.txt"): ("Proprietary", "own", None),
        (10, "b/two.txt"): ("Proprietary", "inherited", "b"),
    }


def test_empty_and_native(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, path string")
    out = op.scan(docs, F.col("path"))
    assert out.count() == 0
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())


def test_licences_stay_with_their_rows_when_files_are_split_anew(spark, tmp_path):
    for k in range(6):
        rows = [(10 * k + j, "Licensed under the MIT License." if j % 3 == 0 else "no licence in here") for j in range(10)]
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    late = op.scan(docs, F.concat(F.lit("/d"), F.col("doc_id").cast("string"), F.lit("/x")))
    try:
        # as if cores had been lost between the jobs: fewer, larger splits
        spark.conf.set("spark.sql.files.minPartitionNum", "1")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        assert {r["doc_id"] for r in late.collect() if r["basis"] == "own"} == {d for d in range(60) if d % 10 % 3 == 0}
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_required_terms_are_rare_and_sufficient():
    lines = [line for lines in op.TEMPLATES.values() for line in lines]
    common = {t: 50_000 for t in "the of and to in is a this for or any by with be not are you all free work use may work under copy".split()}
    weights = op.Weights(op.TEMPLATES, common | {"license": 900}, 100_000, op.THRESHOLD)
    assert not weights.required & set(common)
    for _, _, v in weights.vectors:
        assert math.sqrt(sum(w * w for t, w in v.items() if t not in weights.required)) < op.THRESHOLD
    assert len(weights.vectors) == len(lines)
