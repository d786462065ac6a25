import hashlib
from collections import Counter

from emberway.llm import warc

PAGES = "page_id long, url string, html string"


def test_a_revisit_is_told_by_its_own_payload(spark):
    """Rows that share a page_id, or have none, each give one record; a unique payload is stored."""
    rows = [(1, "u", "copied"), (1, "u", "unique"), (5, "u", "copied"), (None, "u", "copied"), (None, "u", "other"), (None, "u", "alone"), (6, "u", "other")]
    out = warc.read_archive(spark, warc.write_archive(spark.createDataFrame(rows, PAGES))).collect()
    sha = lambda s: warc.base32(hashlib.sha1(s.encode()).digest())
    refers = {"copied": 5, "other": 6}
    expected = [(p, sha(h), refers[h] if refers.get(h, p) != p else None) for p, _, h in rows]
    assert Counter((r["page_id"], r["payload_digest"], r["refers_to"]) for r in out) == Counter(expected)
    assert all(r["digest_ok"] and (r["record_type"] == "response") == (r["refers_to"] is None) for r in out)


def test_equal_rows_longer_than_a_chunk_stay_apart(spark):
    html = "".join(f"<p>{i}</p>" for i in range(40))
    pages = spark.createDataFrame([(3, "u", html)] * 3 + [(None, "u", html + "x")] * 2, PAGES).coalesce(1)
    out = warc.read_archive(spark, warc.write_archive(pages, chunk=32)).collect()
    assert Counter((r["page_id"], r["payload_bytes"]) for r in out) == Counter({(3, len(html)): 3, (None, len(html) + 1): 2})
    assert all(r["digest_ok"] for r in out) and len({r["record_id"] for r in out}) == 5
