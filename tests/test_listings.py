"""Listings against scanners that go line by line and character by character."""

import hashlib
import random

import pytest

from quernstone.functions import listings as L
from quernstone.plans import listings as P

DATA = "/root/testdata/sf0.001"


def scan_rexx(text):
    """One character at a time, with the state after each."""
    out, cur, depth, quote = [], "", 0, ""
    for line in text.splitlines():
        i = 0
        while i < len(line):
            two, c = line[i : i + 2], line[i]
            if not quote and two == "/*" or depth and two == "*/":
                depth += 1 if two == "/*" else -1
                cur, i = cur + two, i + 2
                continue
            cur, i = cur + c, i + 1
            if quote:
                quote = "" if c == quote else quote
            elif depth:
                pass
            elif c in "'\"":
                quote = c
            elif c == ";":
                out.append(cur)
                cur = ""
        if depth or quote or cur.strip().endswith(","):
            cur += "\n"
        elif cur.strip():
            out.append(cur)
            cur = ""
    return [s.rstrip() for s in (*out, cur) if s.strip()]


def scan_jcl(text):
    lines, out, cur = text.splitlines(), [], None
    i = 0
    while i < len(lines):
        line, after = lines[i], lines[i + 1].lstrip() if i + 1 < len(lines) else ""
        if line.strip() == "//" and "=" in after and not after.startswith("/"):
            line, i = "//" + after, i + 1
        i += 1
        bare = line.lstrip()
        if not bare.startswith("//"):
            cur = None
            if bare:
                out.append([line])
        elif cur is None or (len(bare) > 2 and not (bare[2].isspace() and (len(bare) == 3 or bare[3].isspace()))):
            cur = [line]
            out.append(cur)
        else:
            cur.append(line)
    return ["\n".join(s).rstrip() for s in out]


def scan_entries(text):
    lines = text.splitlines()
    code = lambda x: len(x) == 3 and all(c in "0123456789ABCDEF" for c in x) or len(x) == 5 and x[0] == "U" and x[1:].isdecimal()
    opens = []
    for i, line in enumerate(lines):
        if code(line.strip()):
            near = [x.strip() for x in lines[i + 1 : i + 3] if x.strip()]
            if near and not code(near[0]):
                opens.append(i)
    if not opens:
        return None
    parts = [lines[: opens[0]], *(lines[a:b] for a, b in zip(opens, [*opens[1:], len(lines)], strict=True))]
    out = []
    for k, p in enumerate(parts):
        text, pieces = "\n".join(p).strip(), []
        if k and len(text) > L.LONGEST_ENTRY:
            for x in text.splitlines():
                if pieces and len("\n".join([*pieces[-1], x])) <= L.LONGEST_ENTRY:
                    pieces[-1].append(x)
                else:
                    pieces.append([x])
            out += [(s, True) for s in ("\n".join(q).strip() for q in pieces) if s]
        elif text:
            out.append((text, k > 0))
    return out


def test_programs_with_nested_comments_and_open_strings():
    rng = random.Random(1)
    bits = ["/*", "*/", "'", '"', ";", ",", "\n", " ", "say x", "a=1", "''", "/", "*", "\n\n", "\t", "/* rexx */", "\r\n", ",\n"]
    for _ in range(6000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(30)))
        assert L.rexx_statements(text) == scan_rexx(text), text


def test_cards_and_entries():
    rng = random.Random(2)
    bits = ["//A EXEC", "// DD X", "//  cont", "//", "  //  ", "A=B", " C=D", "data", "", "/*", "//* c", "0C4", "U4038", "Explanation", "0C4 ", "x" * 1800, "/=", "// \t X"]
    for _ in range(4000):
        text = "\n".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert L.jcl_statements(text) == scan_jcl(text), text
        assert L.code_entries(text) == scan_entries(text), text
        joined = [x for t, _ in L.mixed_items(text) for x in t.split("\n") if x.strip()]
        assert joined == [x for x in text.splitlines() if x.strip()] or "//" in [x.strip() for x in text.splitlines()]


@pytest.mark.parametrize(("text", "kind"), [
    ("//A EXEC\n//B DD *\nplain", "jcl"), ("1\n2\n3\n//X DD DATA,DLM=AA\n4\n5", "jcl"), ("//* /* rexx", "jcl"), ("see /* REXX */ here", "rexx"), ("a /* b\nc", "rexx"),
    ("say a\nend\nx = 1", "rexx"), ("say a\nend\nx == 1", None), ("say a; end\nDo not", "rexx"), ("  a\n  b\nc", "console"), ("  a\nb", None), ("", None), (" \n\t", None), ("a /* b */ c", None),
])
def test_regions(text, kind):
    assert L.region(text) == kind


def test_codes_and_units():
    assert L.system_codes("0C4\nfails\n0C4\n\nagain\nU4038\nuser\n0C1\n0C2", "Wait State codes") == ["W0C4", "U4038"]
    assert L.system_codes("0C4\nfails", "Codes") == ["0C4"] and L.is_code_section("0C4\n\nexplanation :\nx") and not L.is_code_section("0C4\ntext\nExplanation:")
    assert L.statements("a  b\nc  d") == [("a  b", True), ("c  d", True)] and L.statements("plain text") == [("plain text", False)]
    assert L.mixed_items("Do:\n//A EXEC\n//  X=1\nthen\n//B DD *\n\nend") == [("Do:", False), ("//A EXEC\n//  X=1", True), ("then", False), ("//B DD *", True), ("\nend", False)]


@pytest.mark.parametrize(("name", "looks", "step", "scan"), [("fn27_jcl_statements", P.JCL, 1, scan_jcl), ("fn28_rexx_statements", P.REXX, 3, scan_rexx), ("fn30_code_entries", P.CODES, 1, scan_entries)])
def test_queries_equal_the_scanners(spark, name, looks, step, scan):
    given = {r.doc_id: r.text for r in P.listing(spark, DATA, looks, step).collect()}
    found = {r.doc_id: (r.units, r.sha256) for r in P.QUERIES[name](spark, DATA).collect()}
    assert found.keys() == given.keys() and len(set(found.values())) > 50
    for k, text in given.items():
        want = None if text is None else scan(text)
        units = want and [u[0] if isinstance(u, tuple) else u for u in want]
        assert found[k] == ((-1, None) if want is None else (len(units), hashlib.sha256("\x1e".join(units).encode()).hexdigest())) or (want is None and found[k][1] is None), k
