import duckdb
import pandas as pd

from skein.llm import chat_format as C


def brute(rows, block):
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "unknown", x or ""))
    out = []
    for c, turns in by.items():
        turns.sort()
        for who in {t[2] for t in turns} - {"system"}:
            for k in range(0, len(turns), block):
                text, spans = "", []
                for _, _, r, x in turns[k : k + block]:
                    text += "<|assistant|>\n" if r == who else "<|system|>\n" if r == "system" else f"<|user:{r}|>\n"
                    if r == who:
                        spans.append((len(text), len(text) + len(x) + 7))
                    text += x + "<|end|>\n"
                out.append((c, who, k // block, len(turns[k : k + block]), text, spans))
    return sorted(out, key=str)


ROWS = [(1, i, ["ann", "bob", "ç"][i % 3], f"turn {i} é") for i in range(300)] + [(2, 0, "system", "be kind"), (2, 1, "user", None), (2, 1, "user", None), (2, None, None, "early"), (3, 0, "system", "alone"), (None, 5, "user", "x"), (None, 6, "assistant", ""), (4, -70, "a", "neg"), (4, 900, "b", "late"), (5, 1, "user", "long " * 50_000)]


def test_rotation(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    for block in (7, 256):
        got = sorted(((r.conv_id, r.speaker, r.block, r.n_turns, r.text, [tuple(s) for s in r.spans]) for r in C.rotate(df, block).collect()), key=str)
        assert got == brute(ROWS, block)
    assert C.rotate(df.limit(0)).collect() == []


def test_oracle_agrees():
    conversations = pd.DataFrame(ROWS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    con = duckdb.connect()
    con.register("conversations", conversations)
    got = sorted(((c, s, b, n, t, [tuple(map(int, x.split("-"))) for x in p.split(",") if x]) for c, s, b, n, t, p in con.sql("SELECT conv_id, speaker, block, n_turns, text, spans FROM (" + C.ORACLE + ")").fetchall()), key=str)
    assert got == brute(ROWS, C.BLOCK)
