"""The transducer against the library, whole texts and parts of every size."""

import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from factsieve.llm import bpe

PATH = bpe.vocabulary_path()
SEA = ["the", " ", "ing", "'s", "'", "re", "É", "é", "é", "Σ", "ß", "数", "字化", "한", "ᄒ", "ᅡ", "12", "٣", "!", "?!", "…", "\n", "\t", "　", "😀", "́", "İ", "<|endoftext|>", "<|end", "oftext|>", "'ll", "a", "xx", "Ᲊ", "Ƛ", "\U00010940", "\x00", "<", "̸"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def words():
    return bpe.vocabulary(PATH)


def texts(seed, n=300):
    rng = random.Random(seed)
    out = ["".join(rng.choice(SEA) for _ in range(rng.choice((1, 3, 10, 60)))) for _ in range(n)]
    out += ["".join(rng.choice("aeinorst") for _ in range(5000)), "字" * 3000, "!" * 3000, "é" * 2500 + "'s", "a" * 9000, "=-" * 3000 + "'re", "", " ", "the " * 400]
    return out


def ids_of(words, text):
    return np.frombuffer(b"".join(bpe.encoded_parts(words, bpe.Known(words), memoryview(text.encode()))), "<u4").tolist()


@pytest.mark.parametrize("piece, block", [(1 << 16, 4096), (40, 4096), (64, 300), (700, 100)])
def test_ids_are_those_of_the_library(words, library, monkeypatch, piece, block):
    monkeypatch.setattr(bpe, "PIECE", piece)
    monkeypatch.setattr(bpe, "BLOCK", block)
    for text in texts(piece):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids_of(words, text) == want, repr(text[:200])


def test_tokens_before_the_lookahead_are_settled(words):
    """Every prefix of a word: boundaries with the lookahead behind them stay, whatever follows."""
    merges, rng = words.merges, random.Random(3)
    assert 1 <= merges.lookahead < 2000
    common = [p.removesuffix(words.end) for p in words.pieces[300:20000:7]]
    for _ in range(60):
        data = "".join(rng.choice(common) for _ in range(60)).encode("utf-8", "ignore")
        data = bytes(b for b in data if b < 128)
        symbols = [words.inner[b] for b in data]
        whole = merges.apply([*symbols[:-1], words.last[data[-1]]])
        edges = set(np.cumsum([len(words.pieces[p].removesuffix(words.end)) for p in whole]).tolist())
        for n in range(merges.lookahead, len(data), 5):
            own = np.cumsum([len(words.pieces[p]) for p in merges.apply(symbols[:n])])
            settled = {int(e) for e in own if e + merges.lookahead <= n}
            assert settled == {e for e in edges if e + merges.lookahead <= n}


def test_lookahead_of_small_lists():
    made = lambda *pairs: bpe.Merges({s: i for i, s in enumerate(sorted({x for p in pairs for x in (*p, p[0] + p[1])} | set("abcd")))}, list(pairs))
    assert made(("a", "b")).lookahead == 1
    assert made(("b", "c"), ("a", "b")).lookahead == 2  # whether ab merges depends on c
    assert made(("c", "d"), ("b", "c"), ("a", "b")).lookahead == 3
    with pytest.raises(ValueError):
        made(("ab", "c"), ("a", "b"))


def test_digest_and_round_trip(spark, library):
    rows = [(i, t) for i, t in enumerate(texts(9, 80))] + [(900, None), (None, "no id"), (3, "again"), (3, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode())))
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r) for r in bpe.digest(docs).collect()), key=key) == sorted(want, key=key)
    back = bpe.decode(bpe.encode(docs)).collect()
    assert {(r.doc_id, r.n_tokens, r.decoded) for r in back} == {(i, n, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for (i, t), (_, n, *_) in zip(rows, want, strict=True)}


def test_plain_decoding_joins_cut_characters(words):
    text = "héé 数字 it's"
    ids = np.array(ids_of(words, text), "<u4").tobytes()
    reader = bpe.Plain(words)
    assert "".join([*(reader.feed(ids[i : i + 4]) for i in range(0, len(ids), 4)), reader.finish()]) == "héé 数字 it 's "
    cut = bpe.Plain(words)
    assert cut.feed(np.array([words.inner[0xC3]], "<u4").tobytes()) == "" and cut.finish() == "�"


def test_awkward_rows_and_clashing_columns(spark, awkward, no_rows):
    assert bpe.digest(awkward).count() == awkward.count() and bpe.digest(no_rows).count() == 0
    clash = awkward.selectExpr("*", "'x' as ids", "'y' as n_tokens", "'z' as decoded", "'w' as ids_sha256")
    coded = bpe.encode(clash)
    assert coded.columns == [*awkward.columns, "decoded", "ids_sha256", "ids", "n_tokens"]
    assert {r.n_tokens for r in coded.where("text is null").collect()} == {0}
    assert bpe.decode(coded, plain=True).where("text = 'one'").first().decoded == "one "
    assert bpe.digest(clash).count() == awkward.count()
