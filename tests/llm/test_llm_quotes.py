"""Quotation links and reply order."""

import random
from collections import defaultdict

from factlake.llm.quotes import keys, normalised, parse, quoted_lines, reply_order

NAMES = "conv_id long, turn long, role string, text string, parent string, body string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", "b") for r in rows], NAMES).repartition(4)


def slow(rows):
    """Parent per (conversation, turn)."""
    own, parents = defaultdict(dict), {}
    for conv, turn, _, text in rows:
        if conv is not None and turn is not None:
            for k in keys(parse(text or "")[0].split("\n")).items():
                own[conv][k] = min(turn, own[conv].get(k, turn))
    votes = defaultdict(lambda: defaultdict(int))
    for conv, turn, _, text in rows:
        if conv is None or turn is None:
            continue
        for level, lines in parse(text or "")[1]:
            hits = [(n, own[conv][h, n]) for h, n in keys(lines).items() if own[conv].get((h, n), turn) < turn]
            if hits:
                n, parent = max(hits)
                votes[conv, turn][level, parent] += n
    for at, found in votes.items():
        parents[at] = max((-level, n, parent) for (level, parent), n in found.items())[2]
    return parents


def check(spark, rows):
    parents = slow(rows)
    got = reply_order(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by_conv = defaultdict(list)
    for r in got:
        at, depth = (r.conv_id, r.turn), 0
        assert r.reply_to == parents.get(at)
        while at in parents:
            at, depth = (r.conv_id, parents[at]), depth + 1
        assert (r.root_turn, r.depth) == (at[1], depth)
        by_conv[r.conv_id].append(r)
    for own in by_conv.values():
        own.sort(key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(own)))
        order = [(r.root_turn is not None, r.root_turn or 0, r.depth, r.turn or 0) for r in own]
        assert order == sorted(order)
    return got


def test_levels_and_announcements():
    text = "Hi\nAnn wrote:\n> one\n> > two\n>> three\n>\n> four\nme"
    assert [n for n, _ in quoted_lines(text)] == [0, 1, 2, 2, 1, 1, 0]
    assert parse(text) == ("Hi\nme", [(1, ["one"]), (2, ["two", "three"]), (1, ["", "four"])])
    assert parse("") == ("", []) and parse("a > b") == ("a > b", [])
    assert normalised("  A\t b C ") == "a b c"
    assert len(keys(["one", "two", "", "three"])) == 5


def test_edge_rows(spark):
    rows = [
        (1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "Ann wrote:\n> How are  YOU?\nFine."),
        (1, 2, "user", "Other topic <|x|>"), (1, 3, "user", "> > how are you?\n> Fine.\nGood!"),
        (1, 4, "user", "> other topic <|x|>\nyes"), (1, 5, None, None), (None, 0, "user", "> Fine."),
        (1, None, "user", "> Fine."), (2, 1, "user", "> Hello there."), (1, 3, "user", "second row of the turn"),
        (3, 0, "user", ""), (3, 0, "user", ""), (4, 0, "u", "x " * 100_000), (4, 1, "u", "> " + "x " * 100_000),
        (None, 1, "user", "> > "),
    ]
    got = check(spark, rows)
    by = {(r.conv_id, r.turn, r.text[:6]): r for r in got}
    assert by[1, 1, "Fine."].reply_to == 0 and by[1, 3, "Good!"].reply_to == 1
    assert by[1, 2, "Other "].formatted == "<|im_start|>user\nOther topic < |x|><|im_end|>\n"
    assert by[1, 5, ""].role == "unknown" and by[4, 1, ""].reply_to == 0


def test_random_conversations(spark):
    rng = random.Random(1)
    rows, texts = [], defaultdict(list)
    for n in range(300):
        conv, turn = rng.choice([1, 1, 1, 2, 3]), n
        own = f"say {rng.randint(0, 40)}\nand {rng.randint(0, 40)}"
        quote = ""
        if texts[conv] and rng.random() < 0.7:
            chosen = rng.choice(texts[conv])
            quote = "".join(f"> {x}\n" for x in chosen.split("\n"))
        rows.append((conv, turn, "user", quote + own))
        texts[conv].append(quote + own)
    check(spark, rows)


def test_a_long_chain_and_a_hot_sentence(spark):
    chain = [(7, i, "user", f"> line {i - 1}\nline {i}" if i else "line 0") for i in range(700)]
    hot = [(8, i, "user", "> same\nsame" if i else "same") for i in range(700)]
    out = {(r.conv_id, r.turn): r for r in reply_order(frame(spark, chain + hot)).collect()}
    assert all(out[7, i].depth == i == out[7, i].position and out[7, i].root_turn == 0 for i in range(700))
    assert all(out[8, i].reply_to == 0 and out[8, i].position == i for i in range(1, 700))


def test_empty_table(spark):
    assert reply_order(frame(spark, [(1, 1, "u", "x")]).limit(0)).collect() == []


def test_conversations_without_quotes_keep_their_turns(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    check(spark, rows)
