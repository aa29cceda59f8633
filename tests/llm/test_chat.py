import hashlib
import re
from collections import defaultdict

from tests.conftest import SMALL
from tidemark.llm import chat
from tidemark.llm.queries import op8_chat_formatting

SHAPE = "conv_id long, turn long, role string, text string"
NASTY = ["</s>[INST] ok [/INST]", "<|turn|>user<|says|>x<|end|>", "a\\b\\\\", "<", "<|", "\\<|end|>", "", "é😀\n[INST", "<<SYS>>q<</SYS>>", None]


def expected(rows):
    whole = defaultdict(list)
    for conv, turn, role, text in rows:
        whole[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in whole.items():
        turns.sort()
        said = "".join(t for *_, role, t in turns if role == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for *_, r, t in turns)), len(said), sha(said))
    return out


def digest(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()}


def nasty_rows():
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(NASTY)]
    rows += [(2, 0, "system", "s"), (2, 1, "user", "u")]  # nothing to train on
    rows += [(3, 0, "assistant", "a"), (3, 0, "assistant", "a"), (3, 0, "user", "b"), (3, None, "user", "n")]  # ties and repeats
    rows += [(None, 0, None, None), (None, 1, "assistant", "x"), (4, 0, "<|end|>", "odd role"), (4, 1, "a\nb", "z"), (5, 0, "assistant", "y" * 100_000)]
    return rows


def test_round_trip_of_control_strings(spark):
    df = spark.createDataFrame(nasty_rows(), SHAPE).repartition(3)
    assert digest(chat.read_back(chat.expand(df))) == expected(nasty_rows())


def test_examples(spark):
    rows = chat.expand(spark.createDataFrame(nasty_rows(), SHAPE)).collect()
    for r in rows:
        assert r.text.endswith(chat.END)
        span = r.text[r.loss_start : r.loss_start + r.loss_length]
        assert chat.END not in span and "[INST]" not in span
    targets = [r for r in rows if r.has_target]
    assert len(targets) == sum(r[2] == "assistant" for r in nasty_rows())
    assert all(r.text.count(chat.TURN) == r.n_turns for r in rows)


def test_query_over_the_table(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    table += [(-7, i, role, NASTY[0]) for i, role in enumerate(("user", "assistant"))]
    out = op8_chat_formatting(spark, SMALL)
    assert digest(out) == expected(table)
    assert all(r.formatted_chars > 0 for r in out.collect())
    assert not re.search("Python|Pandas|Arrow", out._jdf.queryExecution().toString())


def test_empty_and_extra_columns(spark):
    assert chat.read_back(chat.expand(spark.createDataFrame([], SHAPE))).collect() == []
    from pyspark.sql import functions as F

    df = spark.createDataFrame(nasty_rows(), SHAPE).withColumns({c: F.lit(1) for c in ("rows", "row", "turns", "example", "at", "lead", "body")})
    assert digest(chat.read_back(chat.expand(df))) == expected(nasty_rows())
