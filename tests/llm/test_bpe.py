"""The automaton against the tokenizers library: ids, decoded texts, odd characters."""

import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from parlance.llm import bpe as B

TOK = Tokenizer.from_file(public_tokenizers.path(B.TOKENIZER))


@pytest.fixture(scope="module")
def codec():
    return B.codec(B.tokenizer_json())


def ids_of(text):
    return TOK.encode(text or "", add_special_tokens=False).ids


def test_random_texts(codec):
    rng = random.Random(7)
    parts = ["abcdefghijklmnopqrstuvwxyz", "aeioust", "ab", "éèêüßñ日本語اب한글😀", "a'stred l", "0123 ١٢½²ⅷ",
             "\x1c\x1f\x85\xa0  \t\nab", "AΣςİÍé̀ͅ ", "!?.#$%—…'", "<|endoftext|> x<|"]
    for n in range(2500):
        alphabet = "".join(rng.sample(parts, rng.randint(1, 2)))
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) + ("<|startoftext|>" if n % 9 == 0 else "")
        ids = ids_of(text)
        assert codec.encode(text) == ids, repr(text)
        assert codec.decode(ids) == TOK.decode(ids, skip_special_tokens=False)


def test_gadgets_accept_exactly_one_sequence():
    """On a tiny merge list, of all token sequences that spell a word the automaton accepts BPE's."""
    from itertools import product

    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "a"), ("ab", "ab")]
    chars = B.byte_characters()
    vocab = {c: i for i, c in enumerate(chars)} | {c + B.END: 256 + i for i, c in enumerate(chars)}
    for a, b in merges:
        vocab[a + b] = len(vocab)
    auto = B.Automaton(merges, vocab)

    def bpe(word):
        seq = [*word[:-1], word[-1] + B.END]
        for a, b in merges:
            i = 0
            while i < len(seq) - 1:
                if (seq[i], seq[i + 1]) == (a, b):
                    seq[i:i + 2] = [a + b]
                i += 1
        return [vocab[s] for s in seq]

    for n in range(1, 9):
        for w in product("ab", repeat=n):
            word = "".join(w)
            assert auto.encode(word.encode()) == bpe(word), word


def test_query_matches_library(spark, sf="/root/testdata/sf0.001"):
    texts = dict(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    rows = B.op3_bpe_automaton(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = ids_of(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(TOK.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows_and_general_interface(spark, docs_of):
    rows = [(1, None), (2, ""), (3, "  \n"), (4, "Hello" * 30000), (4, "same"), (4, "same"), (None, "x <|endoftext|>")]
    got = sorted(((r.doc_id or 0, r.n_tokens) for r in B.round_trip_digests(docs_of(rows)).collect()))
    assert got == sorted((i or 0, len(ids_of(t))) for i, t in rows)
    full = B.decode_ids(B.encode_documents(docs_of(rows))).collect()
    assert sorted((r.doc_id or 0, r.decoded) for r in full) == sorted(
        (i or 0, TOK.decode(ids_of(t), skip_special_tokens=False)) for i, t in rows)
    assert B.round_trip_digests(docs_of([])).count() == 0


def test_long_words_and_slices(codec):
    """Words read alone, many words read together and texts encoded in slices give the library's ids."""
    rng = random.Random(3)
    texts = ["".join(rng.choice("aeioustrn") for _ in range(n)) for n in (63, 64, 65, 66, 500, 3000)]
    texts += [" ".join("".join(rng.choice("abeiourstnéß,'") for _ in range(rng.randint(1, 12))) for _ in range(9000)),
              "", "<|startoftext|>x<|endoftext|><|endoftext|> <|ENDOFTEXT|> ΑΣ", "日本" * 40 + " \x0b\x85a\u2003b"]
    ids, edges = codec.encode_texts(texts)
    assert [ids[a:b].tolist() for a, b in zip(edges, edges[1:])] == [ids_of(t) for t in texts]
    for most in (1, 100, 10**9):
        parts = list(B.slices(B.pa.array([*texts, None]), most))
        assert [t for p in parts for t in p] == [*texts, ""]
        assert all(sum(map(len, p[:-1])) < most for p in parts)


def test_compiled_arcs_equal_the_gadgets(codec):
    """Arcs decided many at a time from the arrays, and from the table, are those of the gadget rule."""
    rng, auto = random.Random(4), codec.automaton
    tokens = list(auto.base) + list(auto.parts)
    pairs = [(rng.choice(tokens), rng.choice(tokens)) for _ in range(3000)] + list(auto.merge_step)[:3000]
    pairs += [(a, b) for (a, _), (_, b) in zip(list(auto.merge_step)[:2000], list(auto.merge_step)[5:2005])]
    state, token = (B.np.array(x, B.np.int64) for x in zip(*pairs))
    want = [auto.has_arc(a, b, 1 << 30) for a, b in pairs]
    assert auto.arcs(state, token).tolist() == want and auto.arcs(state, token).tolist() == want
    assert any(want) and not all(want)
