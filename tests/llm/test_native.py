"""Secret and license scans against plain Python, and that their plans hold no Python."""

import hashlib
import random
import re

import pytest

from brindle.llm.queries import QUERIES
from tests.llm.data import documents, empty, save

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
LIVE = "k9Jq2LmZ7pRt4"
SHARED = "EXAMPLEVALUE42"


def secret_documents(spark):
    rows = [(200 + i, f"API_KEY = '{SHARED}' and more", "en", f"own{i}", 1) for i in range(6)]
    rows += [(210, f"my password: {LIVE}\nagain Secret={LIVE}", "en", "own1", 1), (211, "é token:short token: abc123 AKIA" + "B" * 16 + " AKIA1", "en", None, 1), (212, "deadbeef" * 4 + " ABC " + "0" * 23, None, "own2", 1)]
    rows += [(213, "apikey='" + "ab12" * 8 + "' ghp_" + "a1B2" * 6, "en", "own3", 1), (213, "other text with the same id", "en", "own3", 1), (214, "passwd:" * 300 + "zzzzzz", "en", "own4", 1)]
    return documents(spark, 20, clashing=True).unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)


def base_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out)


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)


def test_secrets_equal_plain_python(spark, tmp_path):
    docs = secret_documents(spark)
    got = QUERIES["op5_secret_ownership"](spark, save(tmp_path, spark, documents=docs)).collect()
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, hashlib.sha256(listed(base_spans(r["text"])).encode()).hexdigest(), *[sum(x[3] == k for x in base_spans(r["text"])) for k in ("assign", "access", "hex")]) for r in docs.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in got) == want
    by = {r["doc_id"]: r for r in got}
    assert by[210]["n_owned"] == 2 and "owned:13:26" in by[210]["spans"]
    assert "vendor:" in max(r["spans"] for r in got if r["doc_id"] == 213)
    for r in got:
        base = [x for x in r["spans"].split(",") if x.split(":")[0] in ("assign", "access", "hex")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r["base_sha256"]


def test_copied_examples_are_not_owned(spark, tmp_path):
    got = QUERIES["op5_secret_ownership"](spark, save(tmp_path, spark, documents=secret_documents(spark))).where("doc_id between 200 and 205").collect()
    assert len(got) == 6 and all(r["n_owned"] == 0 and r["n_examples"] == 1 for r in got)


def test_many_matches_in_one_text_and_a_hot_value(spark, tmp_path):
    """A value in a third of the rows, held by one owner; and 20,000 matches in one text, spans against plain Python."""
    long = "".join(f"é token = abcdef{i:05d} " for i in range(20_000))
    rows = [(i, f"x secret={'hotvalue99' if i % 3 == 0 else f'v{i:09d}'}", "en", "own0", 1) for i in range(3000)] + [(9000, long, "en", "own1", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in QUERIES["op5_secret_ownership"](spark, save(tmp_path, spark, documents=docs)).collect()}
    assert len(got) == 3001 and all(got[i]["n_owned"] == 1 and got[i]["n_examples"] == 0 for i in range(3000))
    base = base_spans(long)
    owned = [(m.start(1), 9, m.end(1), "owned") for m in ASSIGN.finditer(long)]
    assert got[9000]["n_assign"] == 20_000 and got[9000]["spans"] == listed(sorted(base + owned))


def test_repositories_alone_make_an_example(spark, tmp_path):
    rows = [(i, "secret=manyrepos77", f"l{i}", f"own{i % 2}", 1) for i in range(6)] + [(10 + i, "secret=fewrepos777", "en", f"own{i % 2}", 1) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: (r["n_owned"], r["n_examples"], r["most_owners"], r["most_repositories"]) for r in QUERIES["op5_secret_ownership"](spark, save(tmp_path, spark, documents=docs)).collect()}
    assert all(got[i] == (0, 1, 2, 6) and got[10 + i] == (1, 0, 0, 0) for i in range(6))


def test_redaction_equals_plain_python(spark):
    from pyspark.sql import functions as F

    from brindle.llm.secrets import redact

    rng, rows = random.Random(4), []
    for i in range(60):
        n = rng.choice([0, 1, 10, 5000, 20000])
        text, at, want = "".join(rng.choice("aé😀\n ") for _ in range(n)), 0, ""
        marks = sorted((s, min(n, s + rng.choice([3, 40, 9000]))) for s in (rng.randrange(n) for _ in range(rng.randint(0, 300) if n else 0)))
        for s, e in marks:
            want += text[at:s] + "[secret]" * (s >= at)
            at = max(at, e)
        rows.append((text, marks, want + text[at:]))
    df = spark.createDataFrame(rows, "t string, m array<struct<start:bigint,end:bigint>>, w string")
    assert df.where(redact(F.col("t"), F.col("m")) != F.col("w")).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def license_row(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    starts, labels = [], set()
    for p, label in PHRASES.items():
        p = p.split()
        hits = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        starts += hits
        labels |= {label} if hits else set()
    return len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def license_documents(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    rows = [(100, "Released under the MIT License. under the mit\nlicense", "en", "a", 1), (101, "CC-BY-NC and cc by nc, Apache License, Version 2.0", "en", "a", 1), (102, f"x y {gpl} z", "en", "a", 1)]
    rows += [(103, gpl.replace("General", "Great"), "en", "a", 1), (104, "ccby nc underthe mit license Éé5 don't", "en", "a", 1), (105, "the license of the public " * 40, "en", "a", 1), (102, "same id again", "en", "a", 1)]
    return documents(spark, 20, clashing=True).unionByName(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)


def test_licenses_equal_plain_python(spark, tmp_path):
    docs = license_documents(spark)
    got = QUERIES["op9_license_diagonals"](spark, save(tmp_path, spark, documents=docs)).collect()
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    want = sorted(((r["doc_id"], *license_row(r["text"])) for r in docs.collect()), key=key)
    assert sorted(((r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got), key=key) == want
    labels = {(r["doc_id"], r["n_words"]): r for r in got}
    assert labels[(102, 15)]["labels"] == "gpl-3" and labels[(102, 15)]["score"] == 1.0
    assert labels[(103, 12)]["labels"] in ("", "gpl-3") and labels[(105, 200)]["labels"] == ""
    assert all(set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def likeness(template, words):
    """(similarity, start, end) of the stretch of words most like the template, by plain edit distance."""
    row = [(0, j) for j in range(len(words) + 1)]
    for i, x in enumerate(template, 1):
        new = [(i, 0)]
        for j, y in enumerate(words, 1):
            new.append(min((row[j - 1][0] + (x != y), row[j - 1][1]), (row[j][0] + 1, row[j][1]), (new[-1][0] + 1, new[-1][1])))
        row = new
    distance, start = min(row)
    return 1 - distance / len(template), start, row.index((distance, start))


def test_labels_against_brute_force(spark, tmp_path):
    """Notices with edits among other words: labels by the edit distance of every template to every stretch of the text."""
    from brindle.llm import licenses

    rng, rows = random.Random(8), []
    filler = "river stone window garden paper orange yellow system report number any the of in this".split()
    for i in range(60):
        words = [rng.choice(filler) for _ in range(rng.randint(0, 40))]
        for label, text in rng.sample(licenses.TEMPLATES, rng.choice([0, 1, 1, 2])):
            w = licenses.words_of(text)
            for _ in range(rng.choice([0, 0, 1, len(w) // 10, len(w) // 3, len(w) // 2])):
                at = rng.randrange(len(w))
                w[at : at + 1] = rng.choice([[], ["river"], [w[at], "stone"]])
            words += w + [rng.choice(filler) for _ in range(rng.randint(10, 30))]
        rows.append((i, ", ".join(words), "en", "s", 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    templates, same, wrong = [(x, licenses.words_of(t)) for x, t in licenses.TEMPLATES], 0, []
    for r in licenses.scan(docs).collect():
        words = WORD.findall(rows[r["doc_id"]][1])
        want, best = set(r["base"]), (1.0,)
        while best[0] >= licenses.SIMILAR:
            best = max((*likeness(t, words), label) for label, t in templates)
            if best[0] >= licenses.SIMILAR:
                want.add(best[3])
                words[best[1] : best[2]] = [None] * (best[2] - best[1])
        same += set(r["labels"]) == want
        if set(r["labels"]) - want:
            wrong.append((r["doc_id"], r["labels"], want))
    assert not wrong and same >= 57  # a notice whose edits leave few k-grams whole may have too few votes


def test_many_notices_in_one_text_and_parts(spark, tmp_path):
    from brindle.llm import licenses

    agpl = dict(licenses.TEMPLATES)["agpl"]
    half = " ".join(licenses.words_of(licenses.TEMPLATES[0][1])[:30])
    rows = [(1, (dict(licenses.TEMPLATES)["isc"] + ". word " * 20) * 3000, "en", "s", 1), (2, f"x {agpl}. y", "en", "s", 1), (3, half, "en", "s", 1), (4, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r for r in licenses.scan(docs).collect()}
    assert len(got[1]["spans"]) == 3000 and got[1]["labels"] == ["isc"]
    assert got[2]["labels"] == ["agpl"] and got[2]["score"] == 1.0 and got[3]["labels"] == [] and got[4]["labels"] == []


def test_real_tables(spark, small):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in QUERIES["op9_license_diagonals"](spark, small).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == license_row(texts[r["doc_id"]])
    for r in QUERIES["op5_secret_ownership"](spark, small).collect():
        assert r["base_sha256"] == hashlib.sha256(listed(base_spans(texts[r["doc_id"]])).encode()).hexdigest()


@pytest.mark.parametrize("name", ["op5_secret_ownership", "op9_license_diagonals"])
def test_empty_and_native(spark, tmp_path, name):
    df = QUERIES[name](spark, save(tmp_path, spark, documents=empty(spark)))
    assert df.count() == 0 and not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().toString())
