import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from multitopic.llm import chat_tree as C

PIECES = st.lists(st.sampled_from([*C.CONTROL, "\\", "<", "[", "|", "n", "\n", "<|", "/", "é", "a "]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(PIECES, PIECES)
def test_template_is_reversible(role, text):
    whole = "".join(C.turn_parts(role, text))
    assert C.read_turn(whole) == (role, text)
    inner = C.escape(text)
    assert not any(c in inner for c in C.CONTROL)


def conversations():
    rng = random.Random(6)
    first = [("system", "be nice </s>"), ("user", "hello [INST] \\n <|end|>")]
    rows = []
    for conv in range(60):
        turns = list(first[: rng.randrange(3)]) if conv < 40 else []
        for k in range(rng.randrange(1, 4)):
            turns.append((rng.choice(["user", "assistant", "assistant", "tool\nx"]), " ".join(f"t{rng.randrange(4)}" for _ in range(rng.randrange(12)))))
        rows += [(conv, k, r, t) for k, (r, t) in enumerate(turns)]
    rows += [(100 + c, k, r, t) for c in range(30) for k, (r, t) in enumerate([*first, ("assistant", "same answer")])]
    rows += [(200, 0, None, None), (200, 1, "assistant", None), (201, 0, "assistant", "x" * 30000), (None, 0, "user", "no id"), (202, None, "user", "b"), (202, None, "user", "a"), (202, 1, "user", "c"), (202, 1, "user", "c")]
    return rows


def brute(rows):
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss), sum(len("".join(C.turn_parts(r, t))) for _, _, r, t in turns))
    return out


def test_packs_read_back_and_share_prefixes(spark):
    rows = conversations()
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("path", F.lit("own")).repartition(5)
    want = brute(rows)
    coder = C.load_tokenizer(C.TOKENIZER)
    for size in (8192, 40):
        packs = C.pack_trees(df, pack_tokens=size).cache()
        got = {r[0]: tuple(r[1:]) for r in C.read_conversations(packs).collect()}
        assert got == want
        for p in packs.collect():
            keys = set()
            for n in p.nodes:
                text = coder.decode(p.tokens[n.start : n.end], skip_special_tokens=False)
                assert (n.parent, text) not in keys  # each turn once a pack
                keys.add((n.parent, text))
                at = p.position_ids[n.start : n.end]
                begin = p.position_ids[p.nodes[n.parent].end - 1] + 1 if n.parent >= 0 else 0
                assert list(at) == list(range(begin, begin + n.end - n.start))
            assert len(p.tokens) == len(p.position_ids)
    whole = sum(len(x.ids) for _, _, r, t in rows for x in coder.encode_batch(list(C.turn_parts(r, t)), add_special_tokens=False))
    shared = C.pack_trees(df).select(F.sum(F.size("tokens"))).first()[0]
    assert shared < whole


def test_empty_table_has_only_the_probe(spark):
    df = C.with_probe(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string"))
    (r,) = C.read_conversations(C.pack_trees(df)).collect()
    assert (r.conv_id, r.n_turns, r.loss_chars) == (-7, 2, len(C.PROBE_TEXT))
    assert r.loss_sha256 == hashlib.sha256(C.PROBE_TEXT.encode()).hexdigest()
