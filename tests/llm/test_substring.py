import hashlib
import random
import re

import pytest

from quire.llm import substring_dedup as S

from .common import documents, empty, odd_rows, passage, repeated


def brute(rows, k):
    """rows: (doc_id, text) of distinct ids."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(words)
        for a in range(len(words) - k + 1):
            key = tuple(words[a : a + k])
            if key in seen:
                gone[a : a + k] = [True] * k
            seen.add(key)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out[i] = (len(words), sum(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def run(df, k=20):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in S.remove_repeats(df, k).collect()}


def test_odd_texts(spark):
    assert run(documents(spark)) == brute(odd_rows(), 20)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(spark, seed, monkeypatch):
    monkeypatch.setattr(S, "FLUSH_WINDOWS", 40)
    r = random.Random(seed)
    rows = [(i, " ".join(r.choice(["a", "b"]) for _ in range(r.randint(0, 60)))) for i in range(40)]
    assert run(documents(spark, rows), 6) == brute(rows, 6)


def test_kept_text(spark):
    shared = passage(2, 30)
    out = {r["doc_id"]: r for r in S.remove_repeats(documents(spark, [(1, shared), (2, f"head\n{shared}\n tail  end"), (3, None)])).collect()}
    assert out[2]["kept_text"] == "head\ntail  end" and [tuple(x) for x in out[2]["removed"]] == [(1, 31)]
    assert out[3]["kept_text"] is None and out[3]["n_words"] == 0 and out[1]["kept_text"] == shared


def test_repeated_and_empty(spark):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], r["n_removed"]) for r in S.remove_repeats(repeated(spark)).collect())
    # a null id comes first; rows of one id and text tie, so neither copy of document 1 is the earlier
    assert got == [(False, 1, 40, 0), (False, 1, 40, 40), (False, 1, 40, 40), (False, 2, 40, 40), (True, 0, 0, 0), (True, 0, 40, 0)]
    assert S.remove_repeats(empty(spark)).count() == 0
    kept = S.remove_repeats(documents(spark), carry=("lang", "text", "score"))
    assert kept.columns[-3:] == ["lang", "text", "score"] and {(r["doc_id"], r["text"]) for r in kept.collect()} == set(odd_rows())


def test_words_alike_to_polynomials(spark):
    """Two words on which every polynomial modulo a power of two has one value."""
    one, two = "a", "b"
    for _ in range(10):
        one, two = one + two, two + one
    words = passage(9, 20).split()
    rows = [(1, " ".join([*words[:10], one, *words[10:]])), (2, " ".join([*words[:10], two, *words[10:]])), (3, " ".join([*words[:10], one, *words[10:]]))]
    got = run(documents(spark, rows))
    assert got == brute(rows, 20) and got[2][1] == 0 and got[3][1] == 21


def test_buckets_grow_with_the_input(spark, monkeypatch):
    """Many small buckets give the same rows as few large ones."""
    r = random.Random(8)
    rows = [(i, " ".join(r.choice(["a", "b", "c"]) for _ in range(r.randint(0, 80)))) for i in range(60)]
    monkeypatch.setattr(S, "BUCKET_WINDOWS", 5)
    assert run(documents(spark, rows), 5) == brute(rows, 5)
