import hashlib
import random
import zlib

from emberline.llm import conversations
from emberline.llm.conversations import Fold, Row, Tally
from tests.llm.helpers import with_clashes

SCHEMA = "conv_id long, turn long, role string, text string"


def dijkstra(rows):
    """The least (cost, letters, lines) by search over plain tuples."""
    import heapq

    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    heap, done = [(0, "", 0, 0, ())], set()
    while heap:
        cost, letters, i, state, lines = heapq.heappop(heap)
        if i == len(rows) and state in (0, 3):
            return cost, letters, lines
        if (i, state) in done:
            continue
        done.add((i, state))
        other = 3 if state == 2 else 2
        name = "assistant" if other == 3 else "user"
        heapq.heappush(heap, (cost + 2, letters + "I", i, other, lines + (f"{name}:",)))
        if i < len(rows):
            role, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, letters + "D", i + 1, state, lines))
            if fault in ("", "truncated"):
                extra = fault == "truncated"
                if (state, role[:1]) in step:
                    heapq.heappush(heap, (cost + extra, letters + "K", i + 1, step[state, role[:1]], lines + (f"{role}:{text}",)))
                heapq.heappush(heap, (cost + 2 + extra, letters + "R", i + 1, other, lines + (f"{name}:{text}",)))


def brute(messages):
    found = {}
    for conv, turn, role, text in messages:
        mine = found.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(name.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        mine += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in found.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()[:16]))
        seen, judged = set(), []
        for _, role, text in rows:
            body = text.strip(" \t\n\v\f\r")
            judged.append((role, text, "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"))
            seen.add((role, text))
        turns = [t for t, _, _ in rows if t is not None]
        cost, letters, lines = dijkstra(judged)
        faults = [f for _, _, f in judged]
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
                     sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged, judged[1:])), cost, letters,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def repaired(spark, messages):
    df = with_clashes(spark.createDataFrame(messages, SCHEMA))
    got = conversations.repair(conversations.damage(df)).collect()
    assert len({r["conv_id"] for r in got}) == len(got)
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def made(seed, conversation, rows, turns=None):
    pick = random.Random(seed)
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    texts = ["Yes.", "No!", "so it goes", "", " \n", None, "Why?", "a.b", *(f"text {k}." for k in range(4))]
    return [(conversation, None if pick.random() < 0.05 else pick.randrange(turns or 2 * rows), pick.choice(roles), pick.choice(texts)) for _ in range(rows)]


def test_whole_tables_equal_a_search(spark):
    messages = [m for k in range(120) for m in made(k, k if k else None, 1 + k % 9)]
    messages += made(500, 900, 700) + made(501, 901, 40, turns=3)  # a third of all rows, and many rows of one turn
    messages += [(902, 0, "user", "x" * 300_000 + "."), (902, 1, "assistant", "same."), (902, 1, "assistant", "same."), (902, 2, "user", "same.")]
    dropped = next(t for t in range(100) if zlib.crc32(f"903:{t}".encode()) % 20 == 0)
    messages += [(903, dropped, "user", "gone."), (904, None, None, None), (904, None, None, None)]
    random.Random(1).shuffle(messages)
    got, want = repaired(spark, messages), brute(messages)
    assert got.keys() == want.keys()
    for conv in want:
        assert got[conv] == want[conv], conv
    assert got[903] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_chunks_of_any_size_add_up():
    pick = random.Random(7)
    for _ in range(150):
        rows = [Row(pick.choice(["user", "assistant", "system", "x", ""]), f"t{k}", k // 2, pick.choice(["", "", "", "truncated", "blank", "duplicate"])) for k in range(pick.randrange(12))]
        cost, letters, lines = dijkstra([(r.role, r.text, r.fault) for r in rows])
        whole = None
        for size in (1, 2, 5, 100):
            fold = Fold()
            for start in range(0, len(rows), size):
                fold.add(rows[start:start + size], Tally(rows[start:start + size]))
            result = fold.result()
            assert (result["cost"], result["audit"]) == (cost, letters)
            assert result["repaired_sha256"] == hashlib.sha256("\n".join(lines).encode()).hexdigest()
            assert whole in (None, result)
            whole = result


def test_weights_put_cost_before_letters():
    rows = [Row("x", "a", 0, ""), Row("x", "b", 1, "")]
    assert conversations.best_paths(rows, [0])[0, 3] == (4, b"RR")
    assert conversations.best_paths([], [0])[0, 3] == (4, b"II")
    assert conversations.best_paths([Row("u", "", 0, "")], [0])[0, 3] == (2, b"KI")


def test_empty_table(spark):
    assert repaired(spark, []) == {}
