import numpy as np
from pyspark.sql import functions as F

from filigree.llm import chat_format
from filigree.llm.packing import decoder, default_tokenizer

ROWS = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "a # b </turn> \\ c"), (2, 0, "user", "hi"), (2, 1, "assistant", "other"), (2, 2, "user", "more\n### assistant: x</turn>\n"),
    (3, 0, "user", "hi"), (4, 0, "system: #1", None), (4, 1, None, ""), (5, 0, "user", "hi"), (5, 1, "assistant", "a # b </turn> \\ c"), (6, 1, "assistant", "y"), (6, 1, "assistant", "x"), (6, 0, "user", "hi"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_trees(spark):
    nodes, last = chat_format.prefix_trees(frame(spark, ROWS), default_tokenizer())
    nodes, last = nodes.collect(), last.collect()
    by = {n.node: n for n in nodes}
    assert len(last) == 6 and len(nodes) == 8  # hi; two answers; more; x, y; system and its answer
    for n in nodes:
        seen, p = [], n.parent
        while p:
            seen.append(by[p])
            p = by[p].parent
        assert n.position == sum(a.n_tokens for a in seen)
        places = {k for a in seen for k in range(a.flat_start, a.flat_start + a.n_tokens)}
        assert places == {k for s in n.attends for k in range(s.a, s.b)}
        assert n.n_tokens * 4 == len(n.ids)
    for tree in {n.tree for n in nodes}:
        ordered = sorted((n for n in nodes if n.tree == tree), key=lambda n: n.flat_start)
        assert [n.flat_start for n in ordered] == [sum(m.n_tokens for m in ordered[:k]) for k in range(len(ordered))]
        for k, n in enumerate(ordered[1:], 1):  # depth first: a node follows its parent's last descendant so far
            assert n.parent == ordered[k - 1].node or any(n.parent == s.parent for s in ordered[:k])


def turns_of(row, decode):
    """(role, text) of each turn and the text under the loss mask, from the tokens alone."""
    ids = [np.frombuffer(p["ids"], "<u4") for p in row.parts]
    whole = "".join(map(decode, ids))
    said = [tuple(chat_format.ESCAPED.sub(r"\1", x) for x in (m[1], m[2])) for m in chat_format.TURN.finditer(whole)]
    loss = [chat_format.ESCAPED.sub(r"\1", decode(i[p["loss_start"] : p["loss_end"]])) for i, p in zip(ids, row.parts, strict=True) if p["loss_end"] > p["loss_start"]]
    return said, loss


def test_texts_come_back(spark):
    """Also of a null conversation, one of many turns, one very long text, and with further columns."""
    rows = [*ROWS, (None, 0, "user", "hi"), (None, 1, "assistant", "of no one"), (7, 0, "user", "hi"), (7, 1, "assistant", "word " * 20_000)]
    rows += [(8, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(400)]
    docs = frame(spark, rows).selectExpr("*", "1 as node", "'x' as tree", "2 as depth", "'p' as parts")
    back = chat_format.read_back(*chat_format.prefix_trees(docs, default_tokenizer())).collect()
    decode = decoder(default_tokenizer())
    assert {r.conv_id for r in back} == {r[0] for r in rows} and len(back) == 9
    for r in back:
        wanted = sorted((t, role or "", text or "") for c, t, role, text in rows if c == r.conv_id)
        said, loss = turns_of(r, decode)
        if r.conv_id == 6:  # two rows of one turn, in either order
            assert sorted(said) == sorted((role, text) for _, role, text in wanted) and sorted(loss) == ["x", "y"]
        else:
            assert said == [(role, text) for _, role, text in wanted]
            assert loss == [text for _, role, text in wanted if role == "assistant" and text]


def test_result_rests_on_intervals_positions_and_mask(spark):
    """A wrong interval, position or loss stretch gives other texts."""
    nodes, last = chat_format.prefix_trees(frame(spark, ROWS), default_tokenizer())
    decode = decoder(default_tokenizer())

    def texts(n):
        return {r.conv_id: turns_of(r, decode) for r in chat_format.read_back(n, last).collect()}

    right = texts(nodes)
    assert texts(nodes.withColumn("attends", F.expr("slice(attends, 1, 0)"))) != right
    assert texts(nodes.withColumn("position", -F.col("position"))) != right
    assert texts(nodes.withColumn("loss_end", F.expr("if(loss_end > loss_start, loss_end - 1, loss_end)"))) != right


def test_no_rows(spark):
    nodes, last = chat_format.prefix_trees(frame(spark, []), default_tokenizer())
    assert nodes.count() == 0 and last.count() == 0
