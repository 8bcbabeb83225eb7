import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from trajq.llm import packing, queries, tokens
from trajq.llm.tokenization import Encoder


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def ids_of(name, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [end]


def first(x):
    return (x is not None, x)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_the_whole_text(name):
    import random

    rng, whole, encoder = random.Random(2), ids_of(name, 7), Encoder(public_tokenizers.path(name), 7, most=500)
    parts = ["aß", "é\nB", "ª", "²", "\xad", "a", "B", " ", "  ", "\n", "\t", "é", "İ", "Σ", " ", " ", "\x1c", "\x85", "'s", "1", "23", "!!", "<|endoftext|>", "the", "\0", "🙂", "漢字", "\r\n", "Word.", "word,"]
    texts = ["".join(rng.choice(parts) if rng.random() < 0.6 else " " for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    for at in range(0, len(texts), 100):
        assert [x.tolist() for x in encoder.ids(texts[at : at + 100])] == [whole(t) for t in texts[at : at + 100]]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_white_space_does_not_stand_in_for_merged_line_ends(name):
    whole, encoder = ids_of(name, 7), Encoder(public_tokenizers.path(name), 7)
    texts = ["a\n\n\nb\tc\td", "a\tb\tc\n\n", "a\n\n b\tc\td", "a\n\nb\xa0c", "a\r\n\nb\rc", "  a\tb\tc", "a b\nc d", "\n", ""]
    assert [x.tolist() for x in encoder.ids(texts)] == [whole(t) for t in texts]


def test_single_spaced_texts_are_told_from_others():
    import sys

    from trajq.llm.tokenization import single_spaced

    spaces = [chr(i) for i in range(sys.maxunicode + 1) if chr(i).isspace()]
    assert single_spaced("a") and single_spaced("a b\nc é 漢") and not single_spaced("")
    for s in spaces:
        assert single_spaced(f"a{s}b") == (s in " \n") and not single_spaced(f"a {s}b") and not single_spaced(f"{s}a") and not single_spaced(f"a\n{s}") and not single_spaced(f"é{s}{s}b")
    assert not single_spaced("a\0b")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_of_single_spaced_texts_are_learnt_once_whatever_stands_around_them(name):
    whole, encoder = ids_of(name, 7), Encoder(public_tokenizers.path(name), 7)
    texts = ["the cat, the cat. The cat; (the cat) the cat's", "Größe, größe! È×É a\u017fb \u0117 12 ½ a1b22", "x\ncat:\nthe cat", "漢字, the <|endoftext|> cat", "_cat_ cat—cat", "the " * 3 + "end"]
    assert [x.tolist() for x in encoder.ids(texts)] == [whole(t) for t in texts]
    assert not encoder.code  # no piece was looked up by itself
    known = encoder.count
    again = [" ".join(["the", *["cat"] * 5]), "a, cat; the cat. a"] * 3
    assert [x.tolist() for x in encoder.ids(again)] == [whole(t) for t in again] and encoder.count <= known + 2


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_words_of_one_hash_are_told_apart(name):
    whole, encoder = ids_of(name, 7), Encoder(public_tokenizers.path(name), 7)
    encoder.hashing.value[:] = 0
    texts = ["one two three", "", "four five, six", "  seven", "one two"]
    for _ in range(2):
        assert [x.tolist() for x in encoder.ids(texts)] == [whole(t) for t in texts]


def test_ranks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 1000, 100_003):
        ranks = (2 ** (rng.random(n) * 32)).astype(np.uint32)
        control, data = tokens.encode_ranks(ranks)
        assert (tokens.decode_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == ranks).all()


def check_ids(docs, got):
    whole = ids_of("byte_bpe_50k.json", 2)
    rows = sorted(((r["doc_id"], whole(r["text"])) for r in docs.select("doc_id", "text").collect()), key=lambda r: (first(r[0]), crc(r[1])))
    at, want = 0, []
    for key, ids in rows:
        want.append((key, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted(((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got.collect()), key=lambda r: r[1]) == want


def test_query_of_ids(spark, sf):
    check_ids(queries.documents(spark, sf), queries.op1_token_ids(spark, sf))


def test_ids_of_odd_rows(odd, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    check_ids(odd, tokens.round_trip(odd, path, 2, 50_257, file_ids=500))
    assert tokens.round_trip(none, path, 2, 50_257).count() == 0


def check_pieces(docs, got):
    whole = ids_of("word_bpe_49k.json", 1)
    want = sorted(((r["doc_id"], whole(r["text"])) for r in docs.select("doc_id", "text").collect()), key=lambda r: (first(r[0]), r[1]))
    rows = got.toPandas()
    for _, s in rows.groupby("sequence_id"):
        s = s.sort_values("offset")
        n = int(s["length"].sum())
        assert (s["length"].cumsum() - s["length"] == s["offset"]).all() and n <= 2048 and (s.sequence_length == n).all()
        assert (s.padded_length == (n if n & (n - 1) == 0 else 2048)).all()
    assert sorted(set(rows.sequence_id)) == list(range(rows.sequence_id.nunique()))
    assert sum(len(ids) for _, ids in want) == rows["length"].sum()
    if len({k for k, _ in want}) == len(want):
        for key, ids in want:
            own = (rows[rows.doc_id.isna()] if key is None else rows[rows.doc_id == key]).sort_values("start")
            assert (own["length"].cumsum() - own["length"] == own["start"]).all() and (own.doc_tokens == len(ids)).all()
            assert own.ids_crc32.tolist() == [crc(ids[a : a + n]) for a, n in zip(own["start"], own["length"])]
    return rows


def test_query_of_packing(spark, sf):
    rows = check_pieces(queries.documents(spark, sf), queries.op7_packing(spark, sf))
    used = rows.groupby("sequence_id").agg(n=("length", "sum"), p=("padded_length", "first"))
    assert used.n.sum() / used.p.sum() > 0.95


def test_packing_of_odd_rows(odd, none, monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    monkeypatch.setattr(packing, "MERGED", 2)  # several levels of leftovers
    rows = check_pieces(odd, packing.pack(odd.repartition(7, "doc_id"), path, 1))
    assert rows[rows.doc_id == 107].groupby("doc_tokens")["length"].sum().sum() == rows[(rows.doc_id == 107)]["length"].sum()
    assert packing.pack(none, path, 1).count() == 0
