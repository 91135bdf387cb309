import hashlib
import random

import numpy as np
import pandas as pd
import pytest

from tabsight.llm import substrings


def brute(rows, depth=100):
    """doc_id -> digest by a dictionary of all windows."""
    seen, out = {}, {}
    for d, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - depth + 1):
            w = raw[i : i + depth]
            if w in seen:
                gone[i : i + depth] = b"\1" * depth
            else:
                seen[w] = True
        kept = bytes(b for b, g in zip(raw, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def digest(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def test_whole_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert digest(substrings.dedup_substrings(docs, bucket_bytes=100_000)) == brute(rows)


@pytest.mark.parametrize("bucket_bytes", [3_000, 1 << 24])
def test_passages_edits_runs_and_borders(make_docs, bucket_bytes):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghé") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    line, passage = text(30), text(60)
    rows = [(1, None), (2, ""), (3, "a" * 99), (4, "a" * 100), (5, "a" * 101), (6, "a" * 3000), (7, "ab" * 700), (8, "short"), (9, "short")]
    rows += [(20 + i, f"{text(rng.randrange(20))} {line} {text(rng.randrange(30))}") for i in range(30)]
    for i in range(15):
        words = passage.split()
        words[rng.randrange(len(words))] = word()
        rows.append((100 + i, " ".join(words) if i % 2 else f"{text(3)} {' '.join(words)} {line}"))
    rows += [(200 + i, rows[40][1]) for i in range(10)] + [(300, passage + " " + passage + passage), (301, "x" * 99 + passage[:100]), (302, passage[:99]), (303, passage[1:101])]
    assert digest(substrings.dedup_substrings(make_docs(rows), bucket_bytes=bucket_bytes)) == brute(rows)


def test_nameless_repeated_and_no_rows(make_docs):
    t = "the same long text " * 8
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in substrings.dedup_substrings(make_docs([(5, t), (5, t), (None, t), (7, None)])).collect())
    first = brute([(0, t)])[0][1]
    assert got == [("5", 152, 152), ("5", 152, 152), ("7", 0, 0), ("None", 152, first)]
    assert substrings.dedup_substrings(make_docs([])).count() == 0


def test_only_the_first_of_equal_contexts_sends_its_windows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = [word() for _ in range(120)]
    edited = [w if i % 20 else "edited" for i, w in enumerate(passage)]

    def sent(copies):
        texts = [f"{text(30)} {' '.join(passage)} {text(30)}" for _ in range(copies)] + [f"{text(30)} {' '.join(edited)} {text(30)}"]
        buckets = [pd.DataFrame({"doc_id": [i], "nameless": [False], "text": [t], "uid": [i], "bucket": np.int32(i)}) for i, t in enumerate(texts)]
        of = lambda told, b: told[told["bucket"] == b["bucket"].iloc[0]]
        told = pd.concat(substrings._compare_digits(iter([substrings._send_digits(b) for b in buckets])))
        opened = told[told["kind"] == substrings.OPEN]
        halves = pd.concat(substrings._compare_halves(iter([substrings._send_halves(b, of(opened, b)) for b in buckets])))
        asked = pd.concat([opened, halves])
        return sum(len(substrings._send_windows(b, of(asked, b))) for b in buckets if b["doc_id"].iloc[0] not in (0, copies))

    assert sent(6) <= 6 * 2 * substrings.DEPTH  # at the ends of a passage contexts differ, inside only the edited copy has others
