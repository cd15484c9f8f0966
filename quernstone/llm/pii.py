"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them, and a
logistic classifier trained on the result decides.

Base finders for email, ip, card and phone always stand. Candidates are their matches, matches that fail their check,
and loose forms (spelled-out email signs, phone numbers without a country code). Six labelers vote yes, no or nothing:
the form's own check, an issuer or name gazetteer, words before the span that name its kind, words that name something
else, the characters at its edges, and its shape. Votes of all documents are counted by pattern (a table whose size the
labelers fix), EM under conditional independence estimates the labelers' reliabilities and each pattern's chance, and a
logistic model over votes and shape is fitted to these chances. Spans that only the classifier finds need a chance of
0.9 and may not overlap a base span. A kind no labeler speaks for adds nothing.

Defined results: a null text is empty and has no spans; repeated rows each get theirs; overlapping base spans of
different kinds all stay; an empty table gives an empty result; offsets are code points. redact() carries all other
columns as they are; elsewhere they are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, written

KINDS = ("email", "ip", "card", "phone")
ADD_FROM = 0.9
ROUNDS, NEAR = 50, 40

HIT = re.compile(r"[0-9@]|[\[(]at[\])]", re.I)
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Equal to the base patterns, but with starts only where a match can start, so that long runs take linear time.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SPELLED = re.compile(r"(?<![\w.+-])[\w.+-]{1,64}\s?[\[(]at[\])]\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[\[(]dot[\])])\s?[A-Za-z]{2,24}){1,4}", re.I)
LOCAL_PHONE = re.compile(r"(?<![\w+.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![\w-])")

# Gazetteers and cue words of the labelers.
DOMAINS = frozenset("com org net edu gov info biz io co de fr es at ch be it uk eu us mx ar cl nl pl pt ca au".split())
ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[4-7]|6011|65|64[4-9]")
CUES = (
    re.compile(r"\b(?:e-?mail|mailto|contact|write|reach|kontakt|correo|courriel|mél)\b"),
    re.compile(r"\b(?:ip|host|server|address|adresse|client|login|dirección)\b"),
    re.compile(r"\b(?:card|visa|mastercard|credit|karte|kreditkarte|carte|tarjeta|payment)\b"),
    re.compile(r"\b(?:phone|tel|telephone|call|mobile|fax|telefon|téléphone|teléfono|móvil)\b"),
)
OTHER = re.compile(r"\b(?:version|release|isbn|issn|order|invoice|serial|sku|hash|token|checksum|build|section|figure|page)\b")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in DOMAIN.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            yield start, end


def candidates(text: str | None) -> list[tuple[int, int, int, bool, str]]:
    """(kind, start, end, base, form) of a text: base spans first, then failed and loose ones."""
    if not text or not HIT.search(text):
        return []
    found = []
    if "@" in text:
        found += [(0, s, e, True, "base") for s, e in emails(text)]
    for m in IP.finditer(text):
        found.append((1, m.start(), m.end(), ok := all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in m[0].split(".")), "base" if ok else "failed"))
    for m in CARD.finditer(text):
        d = digits_of(m[0])
        if 13 <= len(d) <= 19:
            found.append((2, m.start(), m.end(), ok := len(d) >= 16 and luhn(d), "base" if ok else "failed"))
    if "+" in text:
        for m in PHONE.finditer(text):
            found.append((3, m.start(), m.end(), ok := 8 <= len(digits_of(m[0])) <= 15, "base" if ok else "failed"))
    taken = sorted((s, e) for _, s, e, base, _ in found if base)
    loose = [(0, m.start(), m.end(), False, "loose") for m in SPELLED.finditer(text)] if "at" in text.lower() else []
    loose += [(3, m.start(), m.end(), False, "loose") for m in LOCAL_PHONE.finditer(text)]
    k = 0
    for x in sorted(loose, key=lambda x: x[1]):
        while k < len(taken) and taken[k][1] <= x[1]:
            k += 1
        if k == len(taken) or taken[k][0] >= x[2]:
            found.append(x)
    return found


# labelers: 1 yes, -1 no, 0 nothing


def votes(text: str, kind: int, start: int, end: int, form: str) -> tuple[int, ...]:
    span, before = text[start:end], text[max(0, start - NEAR) : start].lower()
    d = digits_of(span)
    check = {"base": 1, "failed": -1, "loose": 0}[form]
    if kind == 0:
        named = 1 if re.split(r"[.\s\])]+", span.lower())[-1] in DOMAINS else -1
        shape = 1 if len(span) <= 64 else -1
    elif kind == 1:
        named = -1 if span.split(".")[0] == "0" else 0
        shape = 1 if max(map(len, span.split("."))) <= 3 else -1
    elif kind == 2:
        named = 1 if ISSUERS.match(d) else -1
        shape = 1 if len(d) in (15, 16) else -1
    else:
        named = 1 if span.startswith("+") and len(d) >= 10 else 0
        shape = 1 if 9 <= len(d) <= 13 and re.search(r"[\x20().-]", span) else -1
    cue = 1 if CUES[kind].search(before) else 0
    other = -1 if OTHER.search(before) else 0
    left, right = text[start - 1 : start] if start else "", text[end : end + 1]
    edge = -1 if (left.isalnum() or right.isalnum() or (left and left in "=#/_\"'")) else 1
    return check, named, cue, other, edge, shape


VOTERS = 6


def cell(found: tuple[int, ...], length: int) -> int:
    """Votes and a length class as one number below 4 * 3**VOTERS."""
    n = min(3, length // 8)
    for v in found:
        n = n * 3 + v + 1
    return n


def uncell(n: int) -> tuple[list[int], int]:
    out = []
    for _ in range(VOTERS):
        n, v = divmod(n, 3)
        out.append(v - 1)
    return out[::-1], n


def described(text: str | None) -> list[tuple[int, int, int, bool, int]]:
    return [(k, s, e, base, cell(votes(text, k, s, e, form), e - s)) for k, s, e, base, form in candidates(text)]


# estimation, on counts of cells


def reliabilities(patterns: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Prior, chances of each vote given yes and no (voters, 3), by EM over distinct vote patterns."""
    prior = 0.5
    yes = np.tile([0.1, 0.3, 0.6], (VOTERS, 1))
    no = np.tile([0.6, 0.3, 0.1], (VOTERS, 1))
    one_hot = np.stack([patterns + 1 == v for v in range(3)], 2).astype(float)
    for _ in range(ROUNDS):
        p = posterior(patterns, prior, yes, no)
        for table, w in ((yes, counts * p), (no, counts * (1 - p))):
            table[:] = np.einsum("n,nvk->vk", w, one_hot) + np.where(table is yes, [0.5, 1.5, 3.0], [3.0, 1.5, 0.5])
            table /= table.sum(1, keepdims=True)
        prior = float((counts @ p + 1) / (counts.sum() + 2))
    return prior, yes, no


def posterior(patterns: np.ndarray, prior: float, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    v = np.arange(VOTERS)
    odds = np.log(prior / (1 - prior)) + (np.log(yes[v, patterns + 1]) - np.log(no[v, patterns + 1])).sum(1)
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def features(patterns: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((len(patterns), 1)), patterns == 1, patterns == -1, np.stack([lengths == k for k in range(1, 4)], 1)], 1).astype(float)


def logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights by Newton steps with a small penalty."""
    w = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        w += np.linalg.solve(h, x.T @ (weight * (target - p)) - 1e-3 * w)
    return w


def fit(counts: dict[tuple[int, int], int]) -> dict[int, frozenset[int]]:
    """From counts by (kind, cell): the cells of each kind whose spans are added."""
    chosen = {}
    for kind in range(len(KINDS)):
        own = sorted((c, n) for (k, c), n in counts.items() if k == kind)
        if not own:
            continue
        parts = [uncell(c) for c, _ in own]
        patterns, lengths = np.array([p for p, _ in parts]), np.array([n for _, n in parts])
        n = np.array([n for _, n in own], float)
        target = posterior(patterns, *reliabilities(patterns, n))
        x = features(patterns, lengths)
        score = 1 / (1 + np.exp(-np.clip(x @ logistic(x, target, n), -30, 30)))
        # what the form's own check turns down stays out
        chosen[kind] = frozenset(c for (c, _), s, p in zip(own, np.round(score, 6), patterns, strict=True) if s >= ADD_FROM and p[0] >= 0)
    return chosen


def accepted(found: list, chosen: dict[int, frozenset[int]]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans, and all spans, each (kind, start, end) by kind, then start."""
    base = sorted((k, s, e) for k, s, e, b, _ in found if b)
    more = [(k, s, e) for k, s, e, b, c in found if not b and c in chosen.get(k, ())]
    return base, sorted(base + more)


def tables(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id and found: the candidates of every whole text with their cells."""
    kind = df.schema[id_column].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "found": [[dict(zip("ksebc", x, strict=True)) for x in described(t)] for t in batch["text"]]})

    return df.selectExpr(f"`{id_column}` AS id", f"`{text_column}` AS text").mapInPandas(run, f"id {kind}, found array<struct<k:int, s:long, e:long, b:boolean, c:int>>")


def learned(found: DataFrame) -> dict[int, frozenset[int]]:
    """Cells to add, from the votes on all candidates of all documents (a table of bounded size)."""
    cells = found.select(F.explode("found").alias("x")).groupBy("x.k", "x.c").count().collect()
    return fit({(r[0], r[1]): r[2] for r in cells})


def shown(spans: list[tuple[int, int, int]]) -> str:
    return ",".join([f"{KINDS[k]}:{s}:{e}" for k, s, e in spans])


def redact(df: DataFrame, text_column: str = "text") -> DataFrame:
    """df with every found span replaced by its kind in angle brackets. Reads the texts twice and moves nothing."""
    chosen = learned(tables(df.select(F.lit(0).alias("id"), F.col(f"`{text_column}`").alias("text")), "id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, place = [], batch.schema.get_field_index(text_column)
            for text in batch.column(place).to_pylist():
                at, parts = 0, []
                for s, e, k in sorted((s, e, k) for k, s, e in accepted(described(text), chosen)[1]):
                    if s >= at:
                        parts += [text[at:s], f"<{KINDS[k].upper()}>"]
                    at = max(at, e)  # what overlaps a span before it goes with that one
                out.append("".join([*parts, text[at:]]) if parts else text)
            yield batch.set_column(place, batch.schema.field(place), pa.array(out, batch.schema.field(place).type))

    return df.mapInArrow(run, df.schema)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    found = written(tables(documents(spark, sf_dir)), "candidates")
    chosen = learned(found)
    kind = found.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for i, cands in zip(batch["id"].tolist(), batch["found"], strict=True):
                base, every = accepted([tuple(x[c] for c in "ksebc") for x in cands], chosen)
                n = [sum(k == x for k, _, _ in base) for x in range(len(KINDS))]
                rows.append((i, *n, hashlib.sha256(shown(base).encode()).hexdigest(), shown(every)))
            yield pd.DataFrame(rows, columns=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    return found.mapInPandas(run, f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


QUERIES = {"op8_pii": op8_pii}
