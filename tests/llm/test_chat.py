import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.llm import chat, queries

SAID = ["</s>[INST] ok [/INST]", "<|im_start|>user\nhi<|im_end|>\n", "<^|im_end|> <^^|", "plain", "", "é😀 <<SYS>> [", "<|nl|>", "\\ ^ < [ $1 \\1"]


def test_round_trip_of_control_strings(spark):
    frame = spark.createDataFrame([(s,) for s in SAID], "t string")
    got = frame.select("t", chat.escape(F.col("t")).alias("e")).withColumn("u", chat.unescape(F.col("e"))).collect()
    for r in got:
        assert r["u"] == r["t"]
        assert not any(c in r["e"] for c in ("<|", "</s>", "[INST]", "[/INST]", "<<SYS>>"))


parts = st.lists(st.sampled_from(["<", "[", "^", "|", "/", "s>", "INST]", "SYS>>", "a", "\n", "<|", "</s>", "<^|"]), max_size=12).map("".join)


@given(st.lists(parts, min_size=30, max_size=30))
@settings(max_examples=8, deadline=None)
def test_escaping_is_reversible(spark, many):
    frame = spark.createDataFrame([(s,) for s in many], "t string")
    assert frame.where(~F.col("t").eqNullSafe(chat.unescape(chat.escape(F.col("t"))))).count() == 0


def test_turns_and_loss_read_back(spark):
    rows = [(c, t, ("user", "assistant", "a\nb")[t % 3], SAID[(c + t) % len(SAID)]) for c in range(3) for t in range(200)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(turns).select("conv_id", "n_turns", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    for r in got.collect():
        own = [x for x in rows if x[0] == r["conv_id"]]
        assert [(t["role"], t["text"]) for t in r["turns"]] == [(x[2], x[3]) for x in own] and r["n_turns"] == len(own)
        assert r["loss"] == "".join(x[3] for x in own if x[2] == "assistant")


def test_typed_parts(spark):
    rows = [(1, 0, "user", [("text", "see <|", None, None), ("image", None, "s3://a", 576), ("text", None, None, None), ("audio", None, "s3://b", None)]), (1, 1, "assistant", [("document", None, "s3://c", 9), ("other", "x", None, 3)]), (1, 2, "user", None)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, parts array<struct<type:string,text:string,ref:string,tokens:long>>")
    r = chat.format_chats(turns).first()
    assert r["formatted"] == "<|im_start|>user\nsee <^|<|image|><|audio|><|im_end|>\n<|im_start|>assistant\n<|document|>x<|im_end|>\n<|im_start|>user\n<|im_end|>\n"
    assert [(a["type"], a["ref"], a["tokens"]) for a in r["attachments"]] == [("image", "s3://a", 576), ("audio", "s3://b", 1), ("document", "s3://c", 9)]
    assert r["expanded_tokens"] == 586


def test_odd_rows(spark):
    rows = [(1, None, None, None, "x"), (1, 0, "user", "", "x"), (1, 0, "user", "", "x"), (None, 5, "assistant", "lost", "x"), (2, 1, "assistant", "y" * 1_000_000, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment string")
    got = {r["conv_id"]: r for r in queries.chat_digests(chat.format_chats(turns)).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == hashlib.sha256(b"\n\nuser\n\nuser\n\n").hexdigest()
    assert got[None]["loss_chars"] == 4 and got[2]["loss_chars"] == 1_000_000
    assert chat.format_chats(turns.limit(0)).collect() == []


def test_an_unrelated_column_named_parts(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi", ["x"], 3), (1, 1, "assistant", "ho", None, 4)], "conv_id long, turn long, role string, text string, parts array<string>, formatted int")
    assert chat.format_chats(turns).first()["formatted"] == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nho<|im_end|>\n"


def test_spans_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(chat, "PIECE", 7)
    rows = [(1, i, "assistant" if i % 2 else "user", "😀é</s>" * (i % 5) + "x" * i) for i in range(40)]
    got = queries.chat_digests(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert got["loss_sha256"] == hashlib.sha256("".join(r[3] for r in rows if r[2] == "assistant").encode()).hexdigest()


def test_main_path_is_native(spark, sf):
    plan = queries.op2_chat_formatting(spark, sf)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "ExistingRDD"))


def test_spans_across_many_segments(spark):
    rows = [(c, None if i == 0 else i, "assistant" if i % 3 else "user", f"said {c} {i} </s>" * (i % 4)) for c in (1, 2, None) for i in range(500)]
    got = queries.chat_digests(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    want = {c: hashlib.sha256("".join(r[3] for r in rows if r[0] == c and r[2] == "assistant").encode()).hexdigest() for c in (1, 2, None)}
    assert {r["conv_id"]: r["loss_sha256"] for r in got} == want and {r["n_turns"] for r in got} == {500}
