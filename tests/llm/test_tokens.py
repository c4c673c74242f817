import random

import pytest
import sentencepiece

from tabsmith.llm.tokens import MODEL, count_tokens, decode, encode, read_model
from tabsmith.llm.unigram import MARK, Lattice


@pytest.fixture(scope="module")
def model():
    return read_model(MODEL)


@pytest.fixture(scope="module")
def lattice(model):
    return Lattice(model)


def brute(model, text):
    """Textbook dynamic programming over the whole text; ties: the piece that begins first."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    plain = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
    least = min(sp.get_score(i) for i in plain.values())
    if not text:
        return []
    s = MARK + text.replace(" ", MARK)
    best = [(0.0, 0, [])] + [None] * len(s)
    for e in range(1, len(s) + 1):
        for b in range(max(0, e - 16), e):
            i = plain.get(s[b:e])
            if i is not None:
                value = best[b][0] + sp.get_score(i)
                if best[e] is None or value > best[e][0]:
                    best[e] = (value, b, [i])
        if s[e - 1] not in plain:
            value = best[e - 1][0] + least - 10
            if best[e] is None or value > best[e][0]:
                best[e] = (value, e - 1, [sp.piece_to_id(f"<0x{x:02X}>") for x in s[e - 1].encode()])
    ids, e = [], len(s)
    while e:
        ids, e = best[e][2] + ids, best[e][1]
    return ids


TEXTS = ["", " ", "a", "the cat  sat ", "über\nStraße\t\x00", "中文字 𝒳 mixed", "   three", "x" * 500, "tion" * 90, "1234567890 token = \"2abc\"", "é" * 70 + "zz"]


def test_ids_match_brute_force_and_round_trip(model, lattice):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("abcdeinorst éß.\n") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    texts += ["".join(rng.choice("aeionrst") for _ in range(700))]  # one segment, far longer than the window
    for text in texts:
        ids = lattice.encode(text)
        assert ids == brute(model, text), text
        assert lattice.decode(ids) == text
        assert lattice.count(text)[0] == len(ids)


def test_best_score_equals_the_library_lattice(model, lattice):
    """The library reads the same file as a unigram model once its type says so; n-best search gives the lattice's best path."""
    head, tail = model.rsplit(b"\x12\x06tok_v0\x18\x02", 1)
    library = sentencepiece.SentencePieceProcessor(model_proto=head + b"\x12\x06tok_v0\x18\x01" + tail)
    for word in "thereby containing wonderful international sentence the with quelque Straßen".split():
        theirs = sum(library.get_score(i) for i in library.nbest_encode(word, 2)[0])
        assert lattice.count(word)[1] >= theirs


def test_memory_of_the_window_is_bounded(lattice):
    from tabsmith.llm.unigram import Window

    widest = []
    real = Window.open

    def watch(self, segment, at):
        real(self, segment, at)
        widest.append(len(self.best))

    Window.open = watch
    try:
        lattice._encode("".join(random.Random(5).choice("etaoinshr") for _ in range(5000)))
    finally:
        Window.open = real
    assert max(widest) < 300


def test_tables(docs, model):
    rows = [(1, None), (2, ""), (3, "hello world"), (3, "hello world"), (None, "a\nb"), (5, "long word " * 30_000)]
    df = docs(rows).withColumnRenamed("lang", "ids")
    counts = {(r.doc_id): r for r in count_tokens(df, model, ["doc_id"]).collect()}
    encoded = encode(df, model, ["doc_id", "text"]).cache()
    got = encoded.collect()
    assert len(got) == 6 and all(r.round_trip and r.n_ids == len(r.ids) == counts[r.doc_id].n_tokens for r in got)
    assert counts[1].n_tokens == counts[2].n_tokens == 0
    assert all(r.decoded == (r.text or "") for r in decode(encoded, model, ["doc_id", "text"]).collect())
    assert count_tokens(df.limit(0), model, ["doc_id"]).collect() == []
