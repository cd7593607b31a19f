import hashlib
import random

import pytest
from tables import SF, against_sql

from slabworks.llm import chat_format as m


def test_query_gives_the_rows_of_its_sql(spark):
    ours, theirs = against_sql(m.op2_chat_format(spark, SF), m.SQL)
    assert ours == theirs


def test_random_turns_come_back():
    rng = random.Random(2)
    bits = [*m.CONTROLS, "\\", "\\\\", "a", "]", "[", "\n", "é", "<", "/"]
    for _ in range(10_000):
        texts = ["".join(rng.choices(bits, k=rng.randint(0, 6))) for _ in range(3)]
        roles = [rng.choice(["user", "assistant", "system", "tool", "", "x]\\", "[INST]", "\\"]) for _ in texts]
        made = [m.format_turn(r, t) for r, t in zip(roles, texts)]
        whole = "".join(x[0] for x in made)
        assert m.recovered(whole) == list(zip(roles, texts))
        assert [m.unescape(x[0][x[1] : x[2]]) for x in made] == texts


def test_only_what_conflicts_is_escaped():
    assert m.format_turn("user", r"C:\new [x] <s ") == (r"[INST]C:\new [x] <s [/INST]", 6, 20, False)
    assert m.format_turn("user", "<s>")[0] == r"[INST]\<s>[/INST]" and m.format_turn("user", "<s>")[3]
    assert m.format_turn("assistant", "end\\")[0] == r"<s>end\\</s>"


@pytest.mark.parametrize("text", ["x", "<s>", "<s>a[/INST]", "[INST]a[INST]", "[TURN:a", "</s>", r"\<s>a</s>", "<s>a</s>x"])
def test_texts_outside_the_grammar(text):
    assert m.parse(text) is None


EDGES = [(1, 0, "tool", "a\\\\b"), (1, None, None, None), (None, 1, "x]", "\\"), (2, 0, "assistant", "end\\"), (2, 0, "assistant", "[INST]\\[TURN:"), (2, 0, "assistant", "end\\"), (3, 5, "user", "z" * 300_000), (4, 1, "assistant", "")]


def test_edges(spark):
    df = spark.createDataFrame(EDGES, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS segment", "2 AS loss")
    frame = df.select("conv_id", "turn", "role", "text").toPandas().astype({"conv_id": "Int64", "turn": "Int64"})
    import duckdb

    con = duckdb.connect()
    con.register("conversations", frame)
    theirs = sorted(str(tuple(r)) for r in con.execute(m.SQL).fetchall() if r[0] != -1)
    assert sorted(str(tuple(r)) for r in m.read_back(m.format_turns(df)).collect()) == theirs
    assert m.format_turns(df).count() == len(EDGES) and m.read_back(m.format_turns(df.limit(0))).count() == 0


def read(pieces):
    reader = m._Reader()
    for piece in pieces:
        reader.add(*piece)
    return reader.row(1)[1:]


def test_a_conversation_is_read_wherever_its_text_is_cut():
    rng = random.Random(4)
    bits = [*m.CONTROLS, "\\", "a", "é", "\n"]
    for _ in range(300):
        turns = [(rng.choice(["user", "assistant", "tool"]), "".join(rng.choices(bits, k=rng.randint(0, 6)))) for _ in range(4)]
        made = [m.format_turn(*t) for t in turns]
        whole, at, spans = "".join(x[0] for x in made), 0, []
        for (role, _), (segment, a, b, _) in zip(turns, made):
            spans.append((at + a, at + b, role == "assistant"))
            at += len(segment)
        want = read([(x[0], x[1], x[2], r == "assistant") for (r, _), x in zip(turns, made)])
        assert want[1] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert want[3] == hashlib.sha256("".join(t for r, t in turns if r == "assistant").encode()).hexdigest()
        cuts = sorted({0, len(whole), *(rng.randrange(len(whole) + 1) for _ in range(5))})
        cut = read([(whole[a:b], 0, 0, False) for a, b in zip(cuts, cuts[1:])])
        assert (cut[0], cut[1], cut[4]) == (want[0], want[1], want[4])
        learnt = "".join(m.unescape(whole[a:b]) for a, b, loss in spans if loss)
        assert want[2] == len(learnt) and want[3] == hashlib.sha256(learnt.encode()).hexdigest()


def test_what_is_learnt_is_what_the_mask_says(spark):
    df = spark.createDataFrame([(1, 0, "user", "abc"), (1, 1, "assistant", "d<s>f")], "conv_id long, turn long, role string, text string")
    turns = m.format_turns(df)
    assert m.read_back(turns).first()["loss_sha256"] == hashlib.sha256(b"d<s>f").hexdigest()
    other = turns.withColumn("loss", ~turns["loss"])
    assert m.read_back(other).first()["loss_sha256"] == hashlib.sha256(b"abc").hexdigest()
    shorter = turns.withColumn("text_end", turns["text_end"] - 1)
    assert m.read_back(shorter).first()["loss_sha256"] == hashlib.sha256(b"d<s>").hexdigest()
    with pytest.raises(Exception, match="isn't of the grammar"):
        m.read_back(turns.withColumn("segment", turns["segment"].substr(1, 6))).collect()
