import hashlib
import random

import pytest

from basketlens.llm import fingerprints as fp
from basketlens.llm import queries
from basketlens.sources.tables import read_table

from .util import SF, docs_frame


def test_order_does_not_matter_and_updates_are_incremental():
    lines = ["first line", "second  line", "", "a b c d e f g", "second  line"]
    f = fp.Fingerprint.of("\n".join(lines))
    assert f == fp.Fingerprint.of("\n".join(reversed(lines)))
    assert f != fp.Fingerprint.of("\n".join(lines[:-1]))          # a multiset, not a set
    assert fp.Fingerprint.of("\n".join(lines[:2])).insert("\n".join(lines[2:])) == f
    assert f.delete("a b c d e f g") == fp.Fingerprint.of("\n".join(x for x in lines if x[:1] != "a"))
    assert str(fp.Fingerprint.parse(str(f))) == str(f)
    assert fp.Fingerprint.of(None) == fp.Fingerprint.of("") != fp.Fingerprint.of("\n")


def test_likeness_follows_what_texts_share():
    rng = random.Random(3)
    text = [f"w{rng.randrange(5000)}" for _ in range(400)]
    f = fp.Fingerprint.of(" ".join(text))
    near = [f.likeness(fp.Fingerprint.of(" ".join(text[: 400 - k] + [f"v{j}" for j in range(k)]))) for k in (0, 40, 100, 200, 400)]
    assert near[0] == 1.0 and near == sorted(near, reverse=True) and near[2] > 0.55 and near[4] < 0.25
    assert fp.Fingerprint.of(" ").likeness(fp.Fingerprint.of("")) == 0.0


def brute(rows):
    """Rows in order (null ids first, then id, then text; null text is empty)."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        nxt = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        e = t[: len(t) - n] + nxt[:n]
        f, g, h = (fp.Fingerprint.of(x) for x in (t, e, nxt))
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), str(f), str(g), f.likeness(g), f.likeness(h)))
    return out


def got(df):
    return [tuple(r) for r in df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next").collect()]


def key(r):
    return (r[0] is not None, r[0] or 0, r[1:])


@pytest.mark.parametrize("rows_per_bucket", [4, 10_000])
def test_edit_report_equals_brute_force(spark, monkeypatch, rows_per_bucket):
    monkeypatch.setattr(fp, "ROWS_PER_BUCKET", rows_per_bucket)
    rng = random.Random(5)
    rows = [(rng.randrange(-50, 1000), "\n".join("wörd" * rng.randrange(4) + str(rng.randrange(9)) for _ in range(rng.randrange(6)))) for _ in range(60)]
    rows += [(1, None), (2, ""), (3, "x" * 50_000), (4, "same"), (5, "same"), (4, "same"), (None, "no id"), (7, "😀" * 9)]
    df = docs_frame(spark, [(i, t, "extra", 0.5) for i, t in rows], "doc_id long, text string, fingerprint string, bucket double")
    assert sorted(got(fp.edit_report(df)), key=key) == sorted(brute(rows), key=key)


def test_one_row_and_no_rows(spark):
    assert got(fp.edit_report(docs_frame(spark, [(9, "abcdefgh")]))) == brute([(9, "abcdefgh")])
    assert got(fp.edit_report(docs_frame(spark, []))) == []


def test_fingerprints_keep_columns_and_replace_a_clashing_one(spark):
    out = fp.fingerprints(docs_frame(spark, [(1, "a", "old"), (1, "a", "old"), (2, None, None)], "doc_id long, text string, fingerprint string")).collect()
    assert sorted((r.doc_id, r.fingerprint) for r in out) == sorted((i, str(fp.Fingerprint.of(t))) for i, t in [(1, "a"), (1, "a"), (2, "")])


def test_query_on_the_whole_table(spark):
    rows = [tuple(r) for r in read_table(spark, SF, "documents").select("doc_id", "text").collect()]
    out = got(queries.QUERIES["op1_fingerprints"](spark, SF))
    assert sorted(out, key=key) == sorted(brute(rows), key=key)
    long = [r for r in out if r[1] > 200]
    assert sum(r[5] > r[6] for r in long) > 0.95 * len(long)
