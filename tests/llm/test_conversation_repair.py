import hashlib
import itertools
import random
import re
import zlib

import pytest

from tallyforge.llm import conversation_repair as cr
from tallyforge.llm import structure as st

WANTED = re.compile("(s?(ua)+)?")
COST = {"K": 0, "R": 2, "D": 3, "I": 2}


def cheapest(symbols):
    """(cost, audit) over all edits of a short sequence, with up to three inserts before each row and at the end."""
    best = None
    inserted = ["", "u", "a", "ua", "au"]
    options = []
    for symbol in symbols:
        initial, extra = st.SYMBOLS[symbol]
        options.append([("I" * len(i), i) for i in inserted])
        rows = [("D", "", 3)]
        if initial:
            rows.append(("K", initial, extra))
            rows += [("R", r, 2 + extra) for r in "ua"]
        options.append(rows)
    options.append([("I" * len(i), i) for i in inserted])
    for chosen in itertools.product(*options):
        if WANTED.fullmatch("".join(c[1] for c in chosen)):
            cost = sum(c[2] if len(c) == 3 else 2 * len(c[0]) for c in chosen)
            best = min(filter(None, (best, (cost, "".join(c[0] for c in chosen)))))
    return best


def answer(matrix):
    last = st.product([matrix[0]] + [[None] * 4] * 3, st.INSERTS)[0]
    return min((last[e][0], st.flat(last[e][1])) for e in st.ENDS if last[e])


def test_matrices_equal_all_edits():
    short = [""] + ["".join(s) for n in (1, 2) for s in itertools.product(st.SYMBOLS, repeat=n)]
    rng = random.Random(2)
    short += ["".join(rng.choice("dsuaxSUAX") for _ in range(3)) for _ in range(60)]
    for symbols, matrix in zip(short, st.matrices(short), strict=True):
        assert answer(matrix) == cheapest(symbols), symbols


def test_grouping_of_products_changes_nothing():
    rng = random.Random(3)
    long_ = ["".join(rng.choice("uauauadsxUA") for _ in range(rng.randint(0, 300))) for _ in range(40)] + ["ua" * 100, "u" * 99, ""]
    rules, rest = st.grammar(long_)
    assert rules and sum(map(len, rest)) < sum(map(len, long_)) / 2
    whole = st.matrices(long_)
    for symbols, matrix in zip(long_, whole, strict=True):
        one = st.EMPTY
        for s in symbols:
            one = st.product(one, st.ROWS[s])
        assert answer(one) == answer(matrix)
        pairs = [(None if x is None else (x[0], st.flat(x[1]))) for line in matrix for x in line]
        assert pairs == [(None if x is None else (x[0], st.flat(x[1]))) for line in one for x in line]


def test_rope_order():
    rng = random.Random(4)

    def rope(s):
        if len(s) < 2 or rng.random() < 0.2:
            return s
        at = rng.randint(1, len(s) - 1)
        return st.joined(rope(s[:at]), rope(s[at:]))

    for _ in range(500):
        a, b = ("".join(rng.choice("DI") for _ in range(rng.randint(0, 9))) for _ in "ab")
        assert st.less(rope(a), rope(b)) == (a < b) and st.flat(rope(a)) == a


SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def by_hand(rows):
    """The whole contract for {conv: rows (turn, role, text) in order} after damage, by dynamic programming over strings."""
    out = {}
    for conv, lines in rows.items():
        turns = [t for t, _, _ in lines if t is not None]
        faults, seen = [], set()
        for _, role, text in lines:
            ended = text.rstrip(SPACE)
            faults.append("b" if not ended else "d" if (role, text) in seen else "t" if ended[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [r[:1] for _, r, _ in lines]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        best = {"": (0, "", [])}  # last initial of the output: cost, audit, repaired rows

        def grow(best, give):
            new = {}
            for last, (cost, audit, repaired) in best.items():
                for c, e, initial, row in give(last, repaired):
                    allowed = initial is None or (initial == "s" and not repaired) or (initial == "u" and last in ("", "s", "a")) or (initial == "a" and last == "u")
                    if allowed:
                        key, value = (last if initial is None else initial), (cost + c, audit + e, repaired + ([row] if row else []))
                        if key not in new or value[:2] < new[key][:2]:
                            new[key] = value
            return new

        def inserts(best):
            for _ in range(3):
                more = grow(best, lambda last, done: [(2, "I", i, (r, "")) for i, r in (("u", "user"), ("a", "assistant"))])
                for key, value in more.items():
                    if key not in best or value[:2] < best[key][:2]:
                        best[key] = value
            return best

        for (_, role, text), fault in zip(lines, faults, strict=True):
            extra = int(fault == "t")
            gone = [(3, "D", None, None)]
            stay = [] if fault in ("b", "d") else [(extra, "K", role[:1], (role, text)), (2 + extra, "R", "u", ("user", text)), (2 + extra, "R", "a", ("assistant", text))]
            best = grow(inserts(best), lambda last, done, gone=gone, stay=stay: gone + stay)
        cost, audit, repaired = min((v for k, v in inserts(best).items() if k in ("", "a")), key=lambda v: v[:2])
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, digest)
    return out


def broken(rows):
    out = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        place = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(place.encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for lines in out.values():
        lines.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), hashlib.md5(x[2].encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(8)
    texts = ["Yes.", "no", "What?", " \t\n", "", "Ok! \n", "é.", "x" * 5000, None, "same", "Well.\x1c", "a.b"]
    rows = [(c, t, rng.choice(["system", "user", "assistant", "tool", "", None, "user", "assistant", "USER", "s"]), rng.choice(texts))
            for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "Hi."), (None, None, "assistant", "Hm."), (None, None, None, None), (70, None, "user", "A."), (70, None, "user", "A."),
             (71, 5, "user", "B."), (71, 5, "user", "B."), (71, 5, "assistant", "B."), (71, -3, "system", "S."), (71, 5, "user", "B.")]
    rows += [(80, t, rng.choice(["user", "assistant"]), f"Line {rng.randrange(40)}{rng.choice(['.', ''])}") for t in range(300)]
    rows += [(90 + c, 0, "user", "Only.") for c in range(40)]  # some of them lose their only row
    return rows


def table(spark, rows):
    filled = [(*r, "k", 1) for r in rows]
    return spark.createDataFrame(filled, "conv_id long, turn long, role string, text string, kind string, conv int").repartition(3)


def test_conversations_equal_brute_force(spark, odd, monkeypatch):
    want = by_hand(broken(odd))
    for piece, at_once in ((cr.PIECE, cr.AT_ONCE), (3, 20)):
        monkeypatch.setattr(cr, "PIECE", piece)
        monkeypatch.setattr(cr, "AT_ONCE", at_once)
        all_ = table(spark, odd)
        got = cr.digests(cr.damaged(all_), all_.select("conv_id")).collect()
        assert len(got) == len(want)
        assert {r[0]: tuple(r[1:]) for r in got} == want
    assert any(v[6] == "" for v in want.values()) and any("R" in v[6] for v in want.values())


def test_repaired_rows_and_empty_tables(spark, odd):
    rows = cr.repaired(table(spark, odd)).orderBy("conv_id", "place").collect()
    by = {}
    for r in rows:
        by.setdefault(r.conv_id, []).append(r.role[:1])
        assert r.edit in "KRI" and (r.edit != "I" or r.text == "")
    assert all(re.fullmatch("s?(ua)+", "".join(v)) for v in by.values())
    none = table(spark, odd).where("false")
    assert cr.digests(none).collect() == [] and cr.repaired(none).collect() == []
    lone = cr.digests(none, table(spark, odd[:1]).select("conv_id")).collect()
    assert [tuple(r) for r in lone] == [(0, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
