import glob
import hashlib

import random
import zlib

import pytest

from skein.llm import sentencepiece_fst as S

sentencepiece = pytest.importorskip("sentencepiece")
MODEL = next(iter(glob.glob("/opt/tokenizers/piece_bpe_32k.model")), None)
pytestmark = pytest.mark.skipif(MODEL is None, reason="no model file")

TEXTS = ["", " ", "Hello world", "  Hello  world\n\n é☃ ", "Ça va? Éeaument de çon, ouèaux!", "aaaaaaaaaaaaaaaaaaaaaaaaaaaa", "x▁y ▁", "中文字符 mixed \U0001f600 and\ttabs\r\n", "def f(x):\n        return x ** 2  # ok", "0123456789 3.14e-10", "Donaudampfschifffahrtsgesellschaft", "\u0000\u0001 z"]


def test_same_ids_as_the_library():
    r, own, lib = random.Random(3), S.Transducer(open(MODEL, "rb").read()), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    alphabet = "eeeaaattthhhssooiinnrrlldd éèçàüßñ  \n.,-'12#<>中▁\U0001f600"
    texts = TEXTS + ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 60))) for _ in range(1500)]
    for t in texts:
        if "\x00" not in t:
            assert own.encode(t) == lib.encode(t), repr(t)
        assert own.decode(own.encode(t)) == t.replace("▁", " "), repr(t)


def test_unigram_path_is_the_best_of_all():
    from sentencepiece import sentencepiece_model_pb2 as pb

    m, r = pb.ModelProto(), random.Random(5)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, False
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = False, False, True
    m.pieces.add(piece="<unk>", score=0, type=2)
    score = {p: -r.random() * 5 for p in ["a", "b", "ab", "ba", "aab", "bb", "abab"]}
    for p, s in score.items():
        m.pieces.add(piece=p, score=s, type=1)
    machine, order = S.Transducer(m.SerializeToString()), ["<unk>", *score]

    def best(t):
        return max(([score[t[:n]] + (best(t[n:]) if t[n:] else 0) for n in range(1, len(t) + 1) if t[:n] in score]), default=-1e9)

    for _ in range(200):
        t = "".join(r.choice("ab") for _ in range(r.randrange(1, 12)))
        got = [order[i] for i in machine.encode(t)]
        assert "".join(got) == t and abs(sum(score[p] for p in got) - best(t)) < 1e-6  # scores are 32-bit in the file


def test_digest(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = [(i, t) for i, t in enumerate(TEXTS[:-1])] + [(99, None), (None, "Hello world"), (2, "Hello world"), (50, "word " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, S.digest(df, MODEL).collect()), key=str)
    want = []
    for d, t in rows:
        ids = lib.encode(t or "")
        want.append((d, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)), hashlib.sha256((t or "").replace("▁", " ").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert S.digest(df.limit(0), MODEL).collect() == []
    assert S.encode(df, MODEL).columns == ["doc_id", "text", "ids"]


def double_array(rules):
    """The bytes of a character map: a double array placed first fit, and the texts."""
    texts, begin = b"", {}
    for read, written in rules.items():
        begin[read.encode()] = len(texts)
        texts += written.encode() + b"\0"
    units, used, bases = {0: 0}, {0}, set()

    def fill(at, keys, depth):
        below = {}
        for k in keys:
            below.setdefault(k[depth] if len(k) > depth else 0, []).append(k)
        base = next(b for b in range(1, 1 << 20) if b not in bases and not any(b ^ c in used for c in below) and (at ^ b) < 1 << 21)
        bases.add(base)
        used.update(base ^ c for c in below)
        units[at] |= (at ^ base) << 10 | (256 if 0 in below else 0)
        for c, some in below.items():
            units[base ^ c] = begin[some[0]] | 1 << 31 if c == 0 else c
        for c, some in below.items():
            if c:
                fill(base ^ c, some, depth + 1)

    fill(0, list(begin), 0)
    packed = b"".join(units.get(k, 0).to_bytes(4, "little") for k in range((max(units) | 255) + 1))
    return len(packed).to_bytes(4, "little") + packed + texts


RULES = {"Ａ": "A", "ﬁ": "fi", "e\u0301": "é", "e": "e", "\t": " ", "\n": " ", "\u200b": "", "㎏": "kg", "…": "...", "ab": "X", "abcd": "Y", "\u3000": " ", "½": "1 2"}


@pytest.mark.parametrize(("kind", "squeeze", "dummy", "fallback"), [(1, True, True, True), (1, False, False, True), (1, True, False, False), (2, True, True, True), (2, False, True, False)])
def test_character_maps_as_in_the_library(kind, squeeze, dummy, fallback):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m, r = pb.ModelProto(), random.Random(7)
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = kind, fallback
    n = m.normalizer_spec
    n.name, n.precompiled_charsmap, n.add_dummy_prefix, n.remove_extra_whitespaces, n.escape_whitespaces = "own", double_array(RULES), dummy, squeeze, True
    for piece, t in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=piece, score=0, type=t)
    if fallback:
        for b in range(256):
            m.pieces.add(piece=f"<0x{b:02X}>", score=0, type=6)
    pieces = ["▁", "a", "b", "c", "d", "A", "X", "Y", "f", "i", "é", "k", "g", ".", "▁a", "▁X", "fi", "kg", "..", "...", "ca", "ad", "▁é", "Yd", "aa", "cad"]
    for k, p in enumerate(pieces):
        m.pieces.add(piece=p, score=-k if kind == 2 else -2 - r.random() * 6, type=1)
    own, lib = S.Transducer(m.SerializeToString()), sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())
    assert S.character_map(n.precompiled_charsmap) == RULES
    parts = [*RULES, "a", "b", "c", "d", " ", "  ", "▁", "中", "é", "\U0001f600"]
    for t in ["", " ", "   ", "\u200b", " \u200b ", *("".join(r.choice(parts) for _ in range(r.randrange(1, 14))) for _ in range(1500))]:
        assert own.encode(t) == lib.encode(t), repr(t)
