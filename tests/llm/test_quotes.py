"""Quotation links and the order of replies against brute force, and long threads."""

import random
import re

import pytest

from tapewise.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, h long, place int, run string"


def frame(spark, rows):
    """Further columns have names that the operator uses itself."""
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def random_conversations(seed):
    """Messages that quote earlier ones, nested, edited, cut or unknown; repeated rows and nulls."""
    rng = random.Random(seed)
    rows = []
    for conv in range(12):
        raw = []
        for turn in range(rng.choice([1, 3, 12, 40])):
            lines = [rng.choice(["Thanks", f"point {rng.randrange(9)} of {conv}", f"Line  {turn} here"]) for _ in range(rng.choice([1, 2, 3]))]
            quoted = []
            for _ in range(rng.choice([0, 0, 1, 2])):
                if raw:
                    source = rng.choice(raw).split("\n")
                    if rng.random() < 0.3:
                        source = source[: rng.randrange(1, len(source) + 1)]
                    if rng.random() < 0.2:
                        source[0] = "edited away"
                    mark = rng.choice(["> ", ">", ">> ", "> > "])
                    quoted += [mark + x.upper() if rng.random() < 0.3 else mark + x for x in source] + ([""] if rng.random() < 0.5 else [])
            text = "\n".join([*quoted, *lines])
            raw.append(text)
            rows.append((conv, turn * 3 - 6, rng.choice(["user", None]), text if rng.random() > 0.05 else None))
            if rng.random() < 0.1:
                rows.append((conv, turn * 3 - 6, "user", f"another text {turn}"))
    return [*rows, *rows[:5], (None, 1, "user", "no conversation"), (3, None, "user", "> Thanks")]


def plain(rows):
    """{(conv, turn): (reply_to, deeper, thread, place)} by loops over all earlier messages."""
    said, asked, out = {}, {}, {}
    for c, t, _, text in rows:
        if c is None or t is None:
            continue
        lines = []
        for x in (text or "").split("\n"):
            m = re.match(r"((?:[ \t]*>)+)[ \t]?", x)
            lines.append((m[1].count(">"), x[m.end() :]) if m else (0, x))
        clean = lambda x: " ".join(x.lower().split())
        parts = lambda xs: {clean(p) for p in [" \n".join(xs), *re.split(r"\n[ \t]*\n", "\n".join(xs))]} - {""}
        own = re.sub(r"\n{3,}", "\n\n", "\n".join(x for d, x in lines if not d)).strip("\n").split("\n")
        said.setdefault((c, t), set()).update(parts(own) | {clean(x) for x in own if clean(x)})
        asks, i = asked.setdefault((c, t), set()), 0
        while i < len(lines):
            j = i
            while j < len(lines) and lines[j][0] == lines[i][0]:
                j += 1
            if lines[i][0]:
                run = [x for _, x in lines[i:j]]
                asks |= {(lines[i][0], 1, p) for p in parts(run)} | {(lines[i][0], 0, clean(x)) for x in run if clean(x)}
            i = j
    for (c, t), asks in asked.items():
        found = {}
        for depth, whole, p in asks:
            for (c2, t2), has in said.items():
                if c2 == c and t2 < t and p in has:
                    found[depth] = max(found.get(depth, (0, -(10**9))), (whole, t2))
        order = [(d, found[d][1]) for d in sorted(found)]
        out[c, t] = (order[0][1] if order else None, order[1:] if order else None)
    below = {}
    for (c, t), (up, _) in sorted(out.items()):
        below.setdefault((c, up), []).append(t)
    places = {}
    for c, t in sorted(k for k, v in out.items() if v[0] is None):
        stack, n = [t], 0
        while stack:
            x = stack.pop()
            places[c, x] = (t, n)
            n += 1
            stack += below.get((c, x), [])[::-1]
    return {k: (*v, *places[k]) for k, v in out.items()}


@pytest.mark.parametrize(("seed", "run"), [(1, 4096), (2, 4)])
def test_against_brute_force(spark, monkeypatch, seed, run):
    monkeypatch.setattr(quotes, "RUN", run)
    rows = random_conversations(seed)
    got = quotes.reply_ordered(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = plain(rows)
    assert sum(v[0] is not None for v in want.values()) > 40
    for r in got:
        if r["conv_id"] is None or r["turn"] is None:
            assert r["thread"] is None
            continue
        reply, deeper, thread, place = want[r["conv_id"], r["turn"]]
        assert (r["reply_to"], r["thread"], r["place"]) == (reply, thread, place)
        assert (None if r["deeper"] is None else [tuple(x) for x in r["deeper"]]) == deeper


def test_a_chain_of_ten_thousand_replies(spark):
    """Each message quotes the one before: rows stay linear, the chat is cut into bounded pieces."""
    rows = [(1, 0, "user", "message 0")] + [(1, t, "user", f"> message {t - 1}\nmessage {t}") for t in range(1, 10_000)]
    chats = sorted(quotes.conversations(frame(spark, rows)).collect(), key=lambda r: r["piece"])
    assert {r["part"] for r in chats} == {0} and max(r["n_messages"] for r in chats) == quotes.PLACES
    assert [int(x) for r in chats for x in re.findall(r"message (\d+)", r["chat"])] == list(range(10_000))
    assert sum(r["n_replies"] for r in chats) == 9_999


def test_repeated_rows_are_kept_in_bounded_rows(spark):
    rows = [(1, 0, "user", "same")] * 1000 + [(1, 1, "user", "> same\n" + "long " * 200_000)]
    chats = quotes.conversations(frame(spark, rows)).collect()
    assert sum(r["n_messages"] for r in chats) == 1001 and max(r["n_messages"] for r in chats) == quotes.COPIES + 1
    assert sum(r["chat"].count("same") for r in chats) == 1000 and max(len(r["chat"]) for r in chats) > 900_000
