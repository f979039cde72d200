"""Ordinary lines with one character or one word changed belong together."""

import random

import pyarrow as pa

from parlance.llm import lines as L

WORDS = ["".join(random.Random(i).choice("abcdefghijklmnopqrst") for _ in range(3 + i % 5)) for i in range(400)]


def edited(seed):
    """A line of 50 to 150 characters, and the same with one character or one short inner word changed."""
    rng = random.Random(seed)
    words, n = [], rng.randint(60, 140)
    while len(" ".join(words)) < n:
        words.append(rng.choice(WORDS))
    line = " ".join(words)
    if seed % 2:
        p = rng.randrange(10, len(line) - 10)
        return line, line[:p] + "Z" + line[p + 1:]
    p = rng.choice([i for i in range(2, len(words) - 2) if len(words[i]) == 3] or [2])
    return line, " ".join([*words[:p], "XYZ", *words[p + 1:]])


def grams(line):
    return {line[i:i + 5] for i in range(max(1, len(line) - 4))}


def test_one_change_links(docs_of):
    pairs = [(a, b) for a, b in map(edited, range(400)) if len(grams(a) & grams(b)) >= 0.8 * len(grams(a) | grams(b))]
    assert len(pairs) > 250 and all(50 <= len(a) <= 150 for a, _ in pairs)
    assert L.similar_pairs(pa.array([x for p in pairs for x in p])).all()
    docs = [(2 * i + k, x) for i, p in enumerate(pairs) for k, x in enumerate(p)]
    gone = {r.doc_id: r.n_removed for r in L.line_digests(docs_of(docs)).collect()}
    assert all(gone[2 * i] == 0 for i in range(len(pairs)))
    assert sum(gone[2 * i + 1] for i in range(len(pairs))) >= 0.98 * len(pairs)     # banding may miss a pair at the threshold


def test_other_lines_stay(docs_of):
    docs = [(i, edited(i)[0]) for i in range(200)]
    assert all(r.n_removed == 0 for r in L.line_digests(docs_of(docs)).collect())
