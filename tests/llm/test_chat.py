import random
import re
from collections import defaultdict

import duckdb
import pytest

from codeatlas.llm import chat


def rows(spark, data):
    return spark.createDataFrame(data, "conv_id long, turn long, role string, text string")


def test_quotes_are_linked_and_removed(spark):
    data = [
        (1, 0, "user", "How do I sort?\nI use Spark."), (1, 1, "assistant", "Use orderBy."), (1, 2, "user", "On Monday X wrote:\n> how do  i sort?\n> I use Spark.\nAnd in Python?"),
        (1, 3, "assistant", "> On Tuesday Y wrote:\n>> How do I sort?\n> And in Python?\nSame there."), (1, 4, "user", "> never said\nok"), (2, 1, "user", "> How do I sort?\nother conversation"),
        (2, 0, "user", None), (None, None, "user", "> > deep\nhi"), (1, 1, "assistant", "Use orderBy."),
    ]
    got = chat.report(rows(spark, data)).collect()
    by = {(r.conv_id, r.turn): r for r in got}
    assert len(got) == len(data)
    assert (by[1, 2].reply_to, by[1, 2].content, by[1, 2].thread) == (0, "And in Python?", 0)
    assert (by[1, 3].reply_to, by[1, 3].thread, by[1, 3].content, by[1, 3].n_quotes) == (2, 0, "Same there.", 3)
    assert (by[1, 4].reply_to, by[1, 4].thread, by[1, 4].content) == (None, 4, "ok")
    assert by[2, 1].reply_to is None and by[2, 0].content == "" and by[None, None].content == "hi"
    assert chat.report(rows(spark, data).limit(0)).count() == 0


def test_long_chain_of_replies(spark):
    data = [(1, 0, "user", "m0")] + [(1, k, "user", f"> m{k - 1}\nm{k}") for k in range(1, 21)]
    got = chat.report(rows(spark, data)).collect()
    assert {r.thread for r in got} == {0} and all(r.reply_to == r.turn - 1 for r in got if r.turn)


def test_deeper_quotes_link_where_nearer_ones_match_nothing(spark):
    data = [
        (1, 0, "user", "How do I sort?\nI use Spark."), (1, 1, "assistant", "Use orderBy."), (1, 2, "user", "> an edited answer\n>> How do I sort?\n>> I use Spark.\nThanks"),
        (1, 3, "user", "> On Tuesday Y wrote:\n>> Use orderBy.\nAgain"), (1, 4, "user", "> Again\n>> How do I sort?\n>> I use Spark.\nno"), (1, 5, "user", "> x\n>> y\n>>> Use orderBy.\nz"),
    ]
    got = {r.turn: (r.reply_to, r.thread) for r in chat.report(rows(spark, data)).collect()}
    assert got == {0: (None, 0), 1: (None, 1), 2: (0, 0), 3: (1, 1), 4: (3, 1), 5: (1, 1)}


def plain(rows):
    """The same by hand, message by message."""
    norm = lambda t: re.sub(r"[ \t\n\x0b\f\r]+", " ", t.lower()).strip(" ")
    read = []
    for conv, turn, role, text in rows:
        passages = []
        for line in (text or "").split("\n"):
            mark = re.match(r"(?:[ \t]*>)*", line)[0]
            level, body = mark.count(">"), re.sub("^ ", "", line[len(mark) :]) if ">" in mark else line
            if passages and passages[-1][0] == level:
                passages[-1][1].append(body)
            else:
                passages.append((level, [body]))
        quoted = any(level for level, _ in passages)
        own = [x for level, lines in passages if not level for x in lines if not (quoted and re.match(chat.INTRODUCTION, x))]
        read.append((conv, turn, role, "\n".join(own).strip(), [p for p in passages if p[0]]))
    said = defaultdict(list)
    for conv, turn, _, content, _ in read:
        for p in {norm(content), *map(norm, content.split("\n"))} - {""}:
            said[conv, p].append(turn)
    links = []
    for conv, turn, _, _, quotes in read:
        votes = defaultdict(lambda: [0, 0])
        for level, lines in quotes:
            whole = "\n".join(lines)
            for p, is_whole in [(whole, 1)] + [(x, 0) for x in dict.fromkeys(lines)]:
                turns = said.get((conv, norm(p)), [])
                if norm(p) and turns and min(turns) < turn and (len(norm(p)) >= chat.MIN_PART or is_whole and len(set(turns)) == 1):
                    votes[level, min(turns)][0] = max(votes[level, min(turns)][0], is_whole)
                    votes[level, min(turns)][1] += 1
        links.append(max(((-level, w, n, first) for (level, first), (w, n) in votes.items()), default=(None,))[-1])
    ups = {(conv, turn): up for (conv, turn, *_), up in zip(read, links) if up is not None}
    out = []
    for (conv, turn, role, content, quotes), up in zip(read, links):
        path = [turn]
        while (conv, path[0]) in ups and (up is not None or len(path) > 1):
            path.insert(0, ups[conv, path[0]])
        out.append((conv, turn, role, len(quotes), up, path[0], "/".join(map(str, path)), content))
    return sorted(out, key=str)


def made(seed):
    """Conversations with nested and branching quotes, edited quotes and short answers."""
    rng, rows = random.Random(seed), []
    for conv in range(40):
        texts = []
        for turn in range(rng.randrange(1, 14)):
            own = [rng.choice(["ok", "thanks", "a line that many say here"]) if rng.random() < 0.3 else f"line {rng.randrange(10**6)} of {conv}/{turn}" for _ in range(rng.randrange(1, 4))]
            quote = []
            if texts and rng.random() < 0.8:
                quote = [f"> {x}" if not x.startswith(">") else f">{x}" for x in rng.choice(texts).split("\n")]
                quote = [q for q in quote if rng.random() < 0.9]
                if rng.random() < 0.3:
                    quote.insert(0, rng.choice(["On Monday X wrote:", "> On Monday X wrote:", "> edited words"]))
            texts.append("\n".join(quote + own))
            rows.append((conv, turn, "user", texts[-1]))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations_match_plain_reading_and_sql(spark, seed):
    data = made(seed)
    got = sorted((tuple(r) for r in chat.report(rows(spark, data)).collect()), key=str)
    assert got == plain(data)
    assert sum(r[4] is not None for r in got) > 100 and max(r[6].count("/") for r in got) > 3
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", data)
    assert sorted(con.sql(chat.SQL).fetchall(), key=str) == got


def test_reply_order_and_short_answers(spark):
    data = [
        (1, 0, "user", "A question of some length"), (1, 1, "user", "> A question of some length\nok"), (1, 2, "user", "> A question of some length\nA second answer"), (1, 3, "user", "> ok\nand then?"),
        (1, 4, "user", "> A second answer\nok"), (1, 5, "user", "> ok\nwhich one"),
    ]
    got = chat.conversations(rows(spark, data)).orderBy("conv_id", "reply_path").collect()
    assert [(r.turn, r.reply_to) for r in got] == [(0, None), (1, 0), (2, 0), (4, 2), (3, None), (5, None)]  # two messages say ok


def test_long_messages_and_columns_of_the_caller(spark):
    long = "\n".join(f"> line number {k}" for k in range(100_000))
    data = [(1, 0, "user", "line number 77", "mine", 5), (1, 1, "user", long + "\nreply", "yours", 6), (1, 2, "user", None, None, None)]
    got = chat.conversations(spark.createDataFrame(data, "conv_id long, turn long, role string, text string, content string, thread int")).orderBy("turn").collect()
    assert [(r.content, r.thread, r.content_, r.reply_to) for r in got] == [("mine", 5, "line number 77", None), ("yours", 6, "reply", 0), (None, None, "", None)]
