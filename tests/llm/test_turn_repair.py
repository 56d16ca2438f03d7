import hashlib
import random
import re
import zlib

from conftest import SF, rows

from wardline.llm import turn_repair
from wardline.llm.queries import QUERIES
from wardline.llm.turn_repair import ENDS, GONE, SOUND, START, TRUNCATED

KIND = "conv_id long, turn long, role string, text string"


def plain_ways(turns, entry=START):
    """State -> least (cost, audit), turn by turn, with up to two new turns before each and at the end."""
    best = {entry: (0, "")}

    def put(states, state, way):
        states[state] = min(way, states.get(state, way))

    def written():
        for _ in range(2):
            for state, (cost, audit) in list(best.items()):
                put(best, 3 if state == 2 else 2, (cost + 5, audit + "I"))

    for symbol in turns:
        written()
        after = {}
        for state, (cost, audit) in best.items():
            put(after, state, (cost + 2, audit + "D"))
            if symbol in GONE:
                continue
            extra = 5 if symbol in TRUNCATED else 0
            role, wanted = symbol.lower(), "a" if state == 2 else "u"
            if role == "s" and state == START:
                put(after, 1, (cost + extra, audit + "K"))
            put(after, 3 if state == 2 else 2,
                (cost + extra, audit + "K") if role == wanted else (cost + extra + 1, audit + "R"))
        best = after
    written()
    return best


def test_every_piece_as_the_plain_automaton():
    r = random.Random(1)
    letters = SOUND * 3 + TRUNCATED + GONE
    for _ in range(800):
        turns = "".join(r.choice(letters) for _ in range(r.randint(0, 9)))
        for entry in range(4):
            plain = plain_ways(turns, entry)
            for leave in range(entry and 1, 4):
                assert turn_repair.best(turns, entry, (leave,)) == plain.get(leave)
        plain = plain_ways(turns)
        assert turn_repair.best(turns) == min(plain[s] for s in ENDS if s in plain)


def test_long_conversations_are_joined_from_pieces():
    r = random.Random(2)
    for size in (turn_repair.PIECE + 1, 70, 257):
        turns = "".join(r.choice("uauauausoUA12") for _ in range(size))
        plain = plain_ways(turns)
        assert turn_repair._cheapest(turn_repair.ways_of(turns, True))[0] == min(plain[s] for s in ENDS if s in plain)


def plain_rows(turns):
    """The contract, conversation by conversation."""
    out = []
    held = {}
    for conv, turn, role, text in turns:
        lines = held.setdefault(conv, [])
        show = [" " if v is None else v for v in (conv, turn, role, text)]
        fault = zlib.crc32(f"{show[0]}:{show[1]}".encode()) % 20
        role, text = "user" if fault == 4 else show[2], show[3]
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        lines += [(turn, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    for conv, lines in held.items():
        lines.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode()))
        seen, symbols, faults = set(), "", []
        for _, role, text in lines:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faults.append(fault)
            kind = {"": SOUND, "truncated": TRUNCATED}.get(fault, GONE)
            symbols += kind["sua".index(role[0]) if role[:1] in ("s", "u", "a") else 3]
        numbers = [t for t, *_ in lines if t is not None]
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(lines, lines[1:], strict=False)]
        plain = plain_ways(symbols)
        cost, audit = min(plain[s] for s in ENDS if s in plain)
        repaired, at, last = [], 0, ""
        for edit in audit:
            new = "assistant" if last == "u" else "user"
            if edit == "I":
                repaired.append(f"{new}:")
            else:
                _, role, text = lines[at]
                at += 1
                if edit == "D":
                    continue
                new = role if edit == "K" else new
                repaired.append(f"{new}:{text}")
            last = new[:1]
        out.append((conv, max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
                    *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
                    sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
                    hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(out, key=repr)


def query_rows(spark, turns, folder):
    turns.write.parquet(f"{folder}/conversations.parquet")
    return rows(QUERIES["op11_turn_repair"](spark, str(folder)))


def test_query_on_the_given_table(spark):
    given = rows(spark.read.parquet(f"{SF}/conversations.parquet"), "conv_id", "turn", "role", "text")
    assert rows(QUERIES["op11_turn_repair"](spark, SF)) == plain_rows(given)


def test_edges_ties_and_long_conversations(spark, tmp_path, monkeypatch):
    r = random.Random(3)
    monkeypatch.setattr(turn_repair, "SEGMENT_BITS", 4)
    given = [(None, 1, "user", "x."), (None, None, None, None), (1, None, "user", None), (1, None, "assistant", "é。"),
             (2, 5, "user", ""), (2, 5, "user", ""), (3, 1, "User", "a."), (3, 1, "ass", "b!\n\t"), (3, 9, "system", "c? ")]
    given += [(4, 0, "user", "same.")] * 6
    # A third of all rows are one conversation, over many segments; a text is longer than all others together.
    given += [(5, r.randint(0, 60), r.choice(["user", "assistant", "system", "tool"]), r.choice(["a.", "b", "", "ü?"]) + str(i % 7))
              for i in range(150)]
    given += [(i, t, "user" if t % 2 == 0 else "assistant", f"text {i} {t}.") for i in range(6, 40) for t in range(r.randint(1, 8))]
    given += [(40, 0, "system", "s."), (40, 1, "user", "long. " * 50_000), (40, 2, "assistant", "ok.")]
    r.shuffle(given)
    frame = spark.createDataFrame(given, KIND).repartition(7)
    for name in ("at", "audit", "cost", "position", "symbol", "first_at"):
        frame = frame.selectExpr("*", f"'clash' AS {name}")
    assert query_rows(spark, frame, tmp_path) == plain_rows(given)


def test_repaired_turns_have_the_form(spark):
    given = [(1, 0, "assistant", "hello."), (1, 1, "user", "cut"), (1, 2, "user", "why?"), (1, 3, "user", "why?"), (2, 0, "user", " ")]
    audits, repaired = turn_repair.repair(spark.createDataFrame(given, KIND))
    assert rows(audits, "conv_id", "duplicate", "truncated", "cost", "audit") == [(1, 1, 1, 6, "RDRD"), (2, 0, 0, 2, "D")]
    assert rows(repaired) == [(1, 0, 0, "user", "hello.", "R"), (1, 1, 2, "assistant", "why?", "R")]


def test_empty_table_and_ids_of_other_types(spark, tmp_path):
    kind = KIND.replace("conv_id long", "conv_id string")
    assert query_rows(spark, spark.createDataFrame([], kind), tmp_path / "none") == []
    given = [("a", 0, "user", "x."), ("a", 1, "assistant", "y."), (None, 0, "user", "z.")]
    assert query_rows(spark, spark.createDataFrame(given, kind), tmp_path / "some") == plain_rows(given)
