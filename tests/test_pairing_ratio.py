from collections import defaultdict
from difflib import SequenceMatcher

from quire.plans import bindings as B
from quire.plans.queries import QUERIES


def runs(spark, d):
    text = "the quick brown fox jumps over a lazy dog while seven grey cats look on from the wall, saying nothing of it"
    rows = [(c, t, "user", text[3 * c + t :] + f" {c} {t}") for c in range(8) for t in range(3)] + [(9, 0, "user", ""), (10, 0, "user", "ab")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{d}/conversations.parquet")
    return B.runs(spark, d)


def fold(a, b, threshold):
    """Pairs of each page as a plain reading of the rule: the best score first, ties by i, then j."""
    pages = defaultdict(lambda: ([], []))
    for side, df in enumerate((a, b)):
        for r in df.collect():
            pages[r["page"]][side].append((r["ix"], r["quote"]))
    pairs, counts = {}, {}
    for page, (x, y) in pages.items():
        found = []
        for i, p in x:
            for j, q in y:
                ratio = SequenceMatcher(None, p, q).ratio()
                held = p in q or q in p
                score = (min(len(p), len(q)) / max(len(p), len(q)) if max(len(p), len(q)) else 1.0) if held else ratio
                if held or ratio >= threshold:
                    found.append((-score, i, j))
        used_i, used_j = set(), set()
        for s, i, j in sorted(found):
            if i not in used_i and j not in used_j:
                used_i.add(i)
                used_j.add(j)
                pairs[page, i, j] = round(-s, 9)
        counts[page] = len(x), len(y), len(used_i)
    return pairs, counts


def test_against_fold(spark, tmp_path):
    d = str(tmp_path)
    a, b = runs(spark, d)
    pairs, counts = fold(a, b, 0.85)
    assert {(r["page"], r["i"], r["j"]): r["score"] for r in QUERIES["greedy_pairing_ratio"](spark, d).collect()} == pairs
    got = {r["page"]: (r["n_a"], r["n_b"], r["matched"]) for r in QUERIES["compare_pages_ratio"](spark, d).collect()}
    assert got == counts
    total = QUERIES["overall_similarity_ratio"](spark, d).first()
    assert total["matched"] == len(pairs) > QUERIES["overall_similarity"](spark, d).first()["matched"]
