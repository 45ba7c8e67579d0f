import zlib

import numpy as np
from tokenizers import Tokenizer

from arcspark.llm import packing, token_store, tokens

PATH = tokens.tokenizer_path()


def _ids(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_words_give_the_ids_of_the_text(rng):
    t, e = Tokenizer.from_file(PATH), tokens.WordEncoder(PATH)
    alphabet = "aZé̂' ’s.,!?…»«0 9٣ßİſ<|>\t\x1c  日本ñ-_+≠~"
    for k in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 14)))
        if k % 50 == 0:
            text += "<|endoftext|>" + text + "<|ENDOFTEXT|>"
        assert np.array(t.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes() == e.encode(text.encode()), repr(text)


def test_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    text = "One two, three! four five two, one six seven one two"
    assert np.frombuffer(tokens.WordEncoder(PATH).encode(text.encode()), dtype="<u4").tolist() == _ids(text)


def test_token_store_round_trip(spark, odd_docs, no_docs, tmp_path):
    path = str(tmp_path / "tokens")
    found = token_store.round_trip(odd_docs, PATH, path=path).collect()
    start, want = 0, []
    rows = sorted(odd_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id, (r.text is not None, (r.text or "").encode())))
    for r in rows:
        ids = np.array([*_ids(r.text), 2], dtype="<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found), key=lambda r: r[1]) == want
    assert token_store.round_trip(no_docs, PATH).collect() == []
    stored = spark.read.parquet(path)
    assert stored.where("doc_id = 9").select("ids").first().ids[-1] == 2


def test_packing(odd_docs, no_docs):
    found = packing.pack(odd_docs, PATH, capacity=64, open_bins=4).collect()
    want = {}
    for r in odd_docs.collect():
        ids = np.array([*_ids(r.text), 0], dtype="<u4")
        for k in range(0, len(ids), 64):
            key = (r.doc_id, k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes()))
            want[key] = want.get(key, 0) + 1
    got = {}
    for r in found:
        key = (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
        got[key] = got.get(key, 0) + 1
    assert got == want
    filled = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert filled.get(r.sequence_id, 0) == r.offset
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 64
    assert packing.pack(no_docs, PATH).collect() == []


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    p = packing.BestFit(10, 3)
    assert [p.place(x) for x in (6, 7, 9)] == [(0, 0), (1, 0), (2, 0)]
    assert p.place(3) == (1, 7)  # free 4, 3 and 1: the tightest that fits
    assert p.place(8) == (3, 0) and p.place(5) == (4, 0)  # with three open, the fullest (9 of 10) closed
    assert p.place(1) == (3, 8)  # so the piece of one goes to the next tightest
    assert p.place(10) == (5, 0)


def test_packing_is_close_to_the_bound(rng):
    p, total = packing.BestFit(2048, 512), 0
    for _ in range(20_000):
        n = rng.randint(1, 2048)
        total += n
        p.place(n)
    assert p.opened <= 1.04 * total / 2048


def test_texts_keep_their_order_whatever_their_size():
    e = tokens.WordEncoder(PATH)
    texts = [b"", None, b"a b " * 40_000, b"", b"c, d", b"x " * 65_536, b"e"]
    one = [tokens.WordEncoder(PATH).encode(t) for t in texts]
    assert list(e.encode_many(texts)) == one and [len(x) // 4 for x in one] == [0, 0, 80_000, 0, 3, 65_536, 1]


def test_words_of_letters_and_slices(rng, monkeypatch):
    t, e = Tokenizer.from_file(PATH), tokens.WordEncoder(PATH)
    assert e._by_word
    letters = "abcxyzàéßÿÉÖÞÃ×÷ªµº1'"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) + rng.choice(["", "", ",", ".)", "<|", "'s"]) for _ in range(4000)]
    texts = [" ".join(words[i : i + 40]).encode() for i in range(0, 4000, 40)]
    want = [np.array(t.encode(x.decode(), add_special_tokens=False).ids, dtype="<u4").tobytes() for x in texts]
    assert list(e.encode_many(texts)) == want
    monkeypatch.setattr(tokens, "_AT_ONCE", 3)
    monkeypatch.setattr(tokens, "CACHE_WORDS", 50)
    e = tokens.WordEncoder(PATH)
    for most in (1, 700):
        parts = list(tokens.slices(tokens.pa.array([*texts, None, b""], tokens.pa.binary()), most))
        assert sum(map(len, parts)) == len(texts) + 2 and [x for p in parts for x in p.to_pylist()] == [*texts, None, b""]
        assert [y for p in parts for y in (np.array(x, dtype="<u4").tobytes() for x in e.encode_array(p).to_pylist())] == [*want, b"", b""]


def test_other_vocabularies_encode_whole_texts():
    other = tokens.tokenizer_path("byte_bpe_50k.json")
    t, e = Tokenizer.from_file(other), tokens.WordEncoder(other)
    assert not e._by_word
    for text in ("Hello  World, again", "", "x\n y é"):
        assert np.frombuffer(e.encode(text.encode()), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_words_that_differ_by_punctuation_share_a_core():
    e, text = tokens.WordEncoder(PATH), "Alpha alpha, alpha. (beta) beta; beta!? 7% 7 été, ÉTÉ."
    assert np.frombuffer(e.encode(text.encode()), "<u4").tolist() == _ids(text)
    assert len(e) == len("alpha (beta beta 7 été , . ) ; !? %".split()) + 1  # É isn't put in lower case before the look-up


def test_all_latin_letters(monkeypatch):
    monkeypatch.setattr(tokens, "_AT_ONCE", 7)
    letters = [chr(c) for c in range(0xC0, 0x100)]
    words = [w for x in letters for w in (x, f"a{x}b", f"{x}{x},", f"z{x}.)")]
    e = tokens.WordEncoder(PATH)
    assert list(e.encode_many([w.encode() for w in words])) == [np.array(_ids(w), dtype="<u4").tobytes() for w in words]


def test_punctuation_is_cut_from_any_slice():
    words = tokens.pa.array(["skipped", "a,", "b", "", "...", "c'd').", "日本。", "日本!", "é̂!", "x<|", "5%", "́?"])
    cut, cores, tails = tokens._cut(words.slice(1))
    assert cut.tolist() == [True, False, False, False, True, False, True, False, False, True, False]
    assert cores.to_pylist() == ["a", "b", "", "...", "c'd", "日本。", "日本", "é̂!", "x<|", "5", "́?"]
    assert tails.to_pylist() == [",", "').", "!", "%"]
    assert [len(x) for x in tokens._cut(words.slice(0, 0))] == [0, 0, 0]


def test_model_without_a_suffix_at_word_ends_is_not_told_apart_by_it():
    model = {"end_of_word_suffix": "</w>", "vocab": {c + s: i for i, (c, s) in enumerate((chr(tokens._BYTES.get(b, b)), s) for s in ("", "</w>") for b in range(256))}}
    assert tokens.WordEncoder._last_tokens(model).tolist() == [False] * 256 + [True] * 256
    assert tokens.WordEncoder._last_tokens({**model, "end_of_word_suffix": None}) is None
    del model["vocab"]["z</w>"]
    assert tokens.WordEncoder._last_tokens(model) is None
    e = tokens.WordEncoder(PATH)
    e._last = None
    assert np.frombuffer(e.encode("One été, two".encode()), "<u4").tolist() == _ids("One été, two")
