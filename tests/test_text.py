"""Normalisation, classification, chunking and enrichment on hand-made cases and properties."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from brindle import pipeline, schema
from brindle.config import Policy, Settings, env, policy_for
from brindle.functions import classify, models, normalize, relevance
from brindle.operators import chunking, enrich, pages


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text, want", [("a?!... b", "a. b"), ("x  　y", "x y"), (" a \n \n\n b\x07 ", "a\n\n\nb"), ("", ""), (None, None)])
def test_clean_text(spark, text, want):
    assert one(spark, normalize.clean_text(F.col("t")), t=text) == want


def test_markup_left_by_models(spark):
    assert one(spark, normalize.strip_markup(F.col("t")), t="a<br/>b<b>c</b>\n\n\n\nd") == "a\nbc\n\nd"


@pytest.mark.parametrize("name, text, want", [("teklif_2024.pdf", "", "Teklif Özeti"), ("x.pdf", "Net Satışlar", "Mali Veri Tabloları"), ("x.pdf", "", "Genel Doküman"), ("x.pdf", None, "Genel Doküman")])
def test_document_type(spark, name, text, want):
    assert one(spark, classify.document_type(F.col("n"), F.col("t")), n=name, t=text) == want


def test_html_layout_names_the_type(spark):
    assert one(spark, classify.document_type(F.col("n"), F.col("t"), F.lit("mali_veri")), n="a.HTM", t="") == "Mali Veri Tabloları"


def test_sections_follow_headings():
    got = chunking.sections("pre\n# A\nt1\n## B\nt2\n# C\nt3")
    assert [(c["header"], c["level"], c["position"]) for c in got] == [("A", 1, 0), ("A > B", 2, 1), ("C", 1, 2)]
    assert chunking.sections("pre\n# A\nt1", keep_preamble=True)[0]["content"] == "pre"


def test_paragraphs(spark):
    text = "aaaa\n\nbbbb\n\ncccccccccccc"
    assert chunking.pack_paragraphs(text, 10) == ["aaaa", "bbbb", "cccccccccccc"] == one(spark, chunking.paragraphs(F.col("t"), 10), t=text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ", max_size=30), max_size=20))
def test_packed_paragraphs_keep_every_word(parts):
    text = "\n\n".join(parts)
    got = chunking.pack_paragraphs(text, 25)
    assert " ".join(got).split() == text.split()
    assert all(len(x) <= 25 or x in [p.strip() for p in text.replace("\n\n", "\n").split("\n")] for x in got)


def test_line_groups(spark):
    text = "## H\nl1\n\nl2\nl3"
    want = ["## T\n\nl1\nl2", "## T\n\nl3"]
    assert chunking.grouped_lines(text, "T", 2) == want == one(spark, chunking.line_groups(F.col("t"), "T", 2), t=text)


def test_bank_records():
    assert chunking.bank_records("Banka: A\nNot: x\n\nBanka: B\nother") == ["## Banka İstihbaratı\n\nBanka: A\nNot: x\nBanka: B"]
    assert chunking.bank_records("nothing") == ["nothing"]


def test_router_drops_short_pieces():
    assert chunking.route("# A\nshort") == [] and chunking.route(None) == []
    assert len(chunking.route("# A\n" + "long line here\n" * 10)) == 1


def test_labels(spark):
    assert one(spark, enrich.doc_label(F.col("n")), n="yeni-istihbarat_raporu.v2.pdf") == "Yeni Istihbarat Raporu.V2"


def test_pages_of_chunks():
    text = "## Sayfa 1\n" + "alpha beta gamma delta " * 5 + "\n# T\n" + "x" * 60 + "\n## Sayfa 2\n# U\n" + "y" * 60
    assert [c["page"] for c in pipeline.chunks_with_pages(text)] == [1, 1, 2]


def test_ingest_rows(spark):
    body = "# Limit Risk\n" + "Firma A satırı 100\n" * 20
    files = spark.createDataFrame([("a_b.txt", body, None), ("none.txt", None, None), ("empty.txt", "", None)], "filename string, text string, html_format string")
    rows = pipeline.ingest(files, models.embedder(models.hash_vectors)).orderBy("chunk_index").collect()
    assert [r["chunk_index"] for r in rows] == [0, 1] and {r["filename"] for r in rows} == {"a_b.txt"}
    assert rows[0]["content"].startswith("[Kaynak: A B | Doküman Türü: ") and "[Bölüm: Limit Risk]" in rows[0]["content"] and len(rows[0]["embedding"]) == 64


@pytest.mark.parametrize("raw, want", [("Sayfa 3 > Limit Bilgileri > Bu bölüm şöyledir:", "Limit Bilgileri"), ("Sayfa 3", None), ("", None), (None, None), ("a" * 91, None)])
def test_headers_as_shown(spark, raw, want):
    assert one(spark, relevance.sanitize_header(F.col("h")), h=raw) == want


def test_pages_of_sources(spark):
    assert one(spark, relevance.source_pages(F.lit(None).cast("string"), F.col("t")), t="## Sayfa 3\nx\n## Sayfa 5") == "3-5"
    assert one(spark, relevance.source_pages(F.lit('{"source_page":"7"}'), F.col("t")), t="## Sayfa 3") == "7"


def test_signals(spark):
    assert one(spark, relevance.numericity(F.col("t")), t="1.234,5 x 7 89") == 1.0
    assert one(spark, relevance.numericity(F.col("t")), t="a" * 98 + "12") == pytest.approx(0.2)
    assert one(spark, relevance.token_overlap(F.col("q"), F.col("c")), q="nakdi risk ne kadar", c="Risk kadardı") == pytest.approx(2 / 3)
    for header, want in (("Limit Risk", 1.0), ("Limit Risk Bilgileri", 0.7), ("limit tablo", 1 / 3)):
        assert one(spark, relevance.header_similarity(F.col("h"), F.array(F.lit("limit risk"))), h=header) == pytest.approx(want)
    assert one(spark, relevance.header_similarity(F.col("h"), F.array().cast("array<string>")), h="x") == 0.0


def test_streamed_tokens_stop_at_the_end_mark(spark):
    lines = F.array(F.lit('data: {"choices":[{"delta":{"content":"a"}}]}'), F.lit("data: {"), F.lit(": x"), F.lit("data: [DONE]"), F.lit('data: {"choices":[{"delta":{"content":"b"}}]}'))
    assert one(spark, models.stream_tokens(lines)) == ["a"]


def test_html_to_markdown():
    html = "<h2>T</h2><p>a <b>b</b></p><ul><li>x</li></ul><table><tr><td>1</td><td>2</td></tr></table><script>no</script>"
    assert pages.html_to_markdown(html) == "## T\n\nab\n\n- x\n\n1 | 2"
    assert pages.html_to_markdown(None) == "" and pages.upload_text("<table><tr><td>a</td><td>b</td></tr></table>") == "a | b"


def test_settings(monkeypatch):
    monkeypatch.setenv("BRINDLE_CHUNK_SIZE", "7")
    assert Settings().chunk_size == 7 and env("NOT_SET_HERE", True) is True and env("X", 3, {"X": "no"}) == 3 and env("X", 0.5, {"X": "2"}) == 2.0
    assert policy_for(" EN ", {"en": Policy(candidate_multiplier=2)}).candidate_multiplier == 2 and policy_for(None).candidate_multiplier == 6


def test_requests_are_checked():
    for bad in (("", 1, 0), ("q", 0, 0), ("q", 21, 0), ("q", 1, 1.5)):
        with pytest.raises(ValueError):
            schema.check_question(*bad)
    with pytest.raises(ValueError):
        schema.check_scope([], None, "")
    assert schema.scope_filenames([" a ", ""], "b") == ["a"] and schema.scope_filenames([], " b ") == ["b"] and schema.scope_filenames(None) is None


def test_embedder_checks_counts(spark):
    with pytest.raises(Exception, match="vectors for"):
        spark.range(3).select(models.embedder(lambda t: [])(F.col("id").cast("string"))).collect()


def test_lines_are_cut_once_for_all_groups(spark):
    """A long text takes time by its lines, not by lines times groups."""
    text = "\n".join(f"line {i} of a long text" for i in range(20_000))
    began = time.time()
    got = one(spark, chunking.line_groups(F.col("t"), "T", 4, "unit"), t=text)
    assert got == chunking.grouped_lines(text, "T", 4, "unit") and len(got) == 5_000
    assert time.time() - began < 30


@pytest.mark.parametrize("text", ["", " \n ", "# a\n", "a", "a\x0bb\x85c d\r\ne f\n\ng", "#\n1\n2\n3\n4\n5"])
def test_line_groups_are_their_plain_twin(spark, text):
    assert one(spark, chunking.line_groups(F.col("t"), "T", 4), t=text) == chunking.grouped_lines(text, "T", 4)
    assert one(spark, chunking.line_groups(F.col("t"), "T", 4), t=None) == [None]
