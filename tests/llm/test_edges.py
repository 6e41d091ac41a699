"""Every operator over odd rows and over empty tables."""

import pytest
from pyspark.sql import functions as F

from tabstat.llm import bpe, chains, chat, decontaminate, line_dedup, lm, ngram_join, pii, quality, warc_zip


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, "quick brown fox"), (1, "quick brown fox"), (2, None), (None, "seven wise OWLS"), (3, "")], "item_id bigint, text string")


REPORTS = {
    "decontaminate": lambda d, items, labels: decontaminate.contamination(d, items),
    "bpe": lambda d, items, labels: bpe.decode(bpe.encode(d.select("doc_id", "text", "lang"), offsets=True)),
    "chains": lambda d, items, labels: chains.repeats(d),
    "ngram_join": lambda d, items, labels: ngram_join.jaccard_classes(d),
    "lm": lambda d, items, labels: lm.score(d),
    "quality": lambda d, items, labels: quality.quality_report(d, labels),
    "pii": lambda d, items, labels: pii.find_pii(d),
}
FILTERS = {
    "decontaminate": lambda d, items, labels: decontaminate.drop_contaminated(d, items),
    "ngram_join": lambda d, items, labels: ngram_join.keep_one(d),
    "line_dedup": lambda d, items, labels: line_dedup.dedup_lines(d, length_col="n_chars", drop_empty=True),
    "quality": lambda d, items, labels: quality.keep_good(d, labels),
}


@pytest.mark.parametrize("name", REPORTS)
def test_report_has_a_row_per_row(name, odd_docs, items, labels):
    out = REPORTS[name](odd_docs, items, labels).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in out) == sorted((r.doc_id is None, r.doc_id or 0) for r in odd_docs.select("doc_id").collect())


@pytest.mark.parametrize("name", REPORTS)
def test_report_of_an_empty_table(name, odd_docs, items, labels):
    assert REPORTS[name](odd_docs.limit(0), items.limit(0), labels.limit(0)).collect() == []


@pytest.mark.parametrize("name", FILTERS)
def test_filter_keeps_columns(name, odd_docs, items, labels):
    out = FILTERS[name](odd_docs, items, labels)
    assert out.columns == odd_docs.columns
    assert 0 < out.count() <= odd_docs.count()
    assert FILTERS[name](odd_docs.limit(0), items.limit(0), labels.limit(0)).count() == 0


def test_line_report_of_odd_rows(odd_docs):
    out = line_dedup.duplicate_lines(odd_docs)
    assert out.where("size(removed) > n_lines").count() == 0
    assert line_dedup.duplicate_lines(odd_docs.limit(0)).count() == 0


def test_conversations_of_odd_rows(spark):
    rows = [(None, 0, "user", None), (1, None, None, "x"), (1, None, None, "x"), (1, 0, "a\nb\\", "<|im_end|>"), (1, 0, "assistant", ""), (2, 5, "assistant", "<\\|im_end|>" + "z" * 100_000)]
    df = spark.createDataFrame([(*r, "y") for r in rows], "conv_id bigint, turn bigint, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    assert {k: r.n_turns for k, r in out.items()} == {None: 1, 1: 4, 2: 1}
    assert out[2].loss_chars == 100_011
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_pages_of_odd_rows(spark, tmp_path):
    big = "p" * 1500
    rows = [(1, "http://a/\r\nX: y", big), (2, None, big), (2, None, big), (None, "u", big), (3, "é", None), (4, "u", ""), (5, "u", "short")]
    df = spark.createDataFrame([(*r, "d", "t") for r in rows], "page_id bigint, url string, html string, digest string, target string")
    out = warc_zip.read_archives(warc_zip.write_archives(df, str(tmp_path / "zips"))).collect()
    got = sorted((r.page_id or "", r.record_type, r.refers_to or "", r.payload_bytes) for r in out)
    assert got == [("", "revisit", "2", 1500), ("1", "revisit", "2", 1500), ("2", "response", "", 1500), ("2", "response", "", 1500), ("3", "response", "", 0), ("4", "response", "", 0), ("5", "response", "", 5)]
    assert warc_zip.read_archives(warc_zip.write_archives(df.limit(0), str(tmp_path / "none"))).count() == 0


def test_repeated_rows_are_kept_once_by_the_join(odd_docs):
    kept = ngram_join.keep_one(odd_docs)
    assert kept.where(F.col("text").startswith("the quick")).count() == 1
    assert kept.where("text is null").count() == 2  # nothing to compare: both stay
