"""Personal data by base patterns and a skip-chain conditional random field.

Base patterns give the certain spans of four kinds.  Beside them stand candidate
units: runs of digits with other separators, local phone formats, addresses written
with "(at)", names (capitalised words after a title or the like, and every later or
earlier place of the same words), street addresses and account numbers.  A document's
units form a field: neighbouring units are joined by chain edges; units that repeat
(same digits, same address, same words) and units that resemble each other (same last
seven digits, same local part, one word of a name in common) are tied by skip edges to
one hub node for each such key, so any two of them, however far apart, are two steps
from each other and the edges stay in proportion to the units.  A hub with a base match
of one kind has that label for certain.  Loopy sum-product
message passing runs until no message moves by more
than a bound; a unit that is labelled with high probability and overlaps no base span
adds a span.  Base spans always stay.

The weights are fitted here, by pseudo-likelihood on documents that
`synthetic_documents` makes (a documented bound: 1,500 of them); nothing is read
from the corpus, so labels depend on the document alone.

How it runs.  One Arrow map over the documents, no shuffle; memory is one batch.
Patterns are written so that they are linear in the text.

Defined results.  Null or empty text: no spans, hash of the empty string.  Ties in
start: kinds in their listed order.  Repeated rows: each reported.  Empty table:
empty result.  Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("email", "ip", "card", "phone")
#: All kinds of spans; label k of the field is kind k - 1, label 0 is none.
KINDS = (*BASE_KINDS, "name", "street", "account", "identity")
LABELS = 1 + len(KINDS)
#: Fixed patterns.  The possessive forms and the look-behind find the same matches as the plain ones, in linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
ANY = re.compile(r"[0-9@]")

#: Units: numbers of seven digits and more under any separators, and addresses in plain or veiled form.
NUMBER = re.compile(r"(?<![A-Za-z0-9])\+?\(?[0-9](?:[\x20().:/_-]{0,2}[0-9])++")
VEILED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}[\x20]?(?:\(at\)|\[at\]|@)[\x20]?[A-Za-z0-9-]{1,63}(?:(?:\.|[\x20]?(?:\(dot\)|\[dot\])[\x20]?)[A-Za-z0-9-]{1,63})+")
#: Words that announce a kind, in the 24 characters before a unit.
CUES = tuple(
    re.compile(p, re.I)
    for p in (
        r"e-?mail|correo|courriel", r"\bip\b|address|host", r"card|karte|carte|tarjeta|visa", r"phone|\btel|call|mobil|fax|fon",
        r"account|konto|compte|cuenta|iban", r"\bssn\b|social security|passport|ausweis|\bdni\b|\bid no",
    )
)
GROUPS_CARD, GROUPS_PHONE = re.compile(r"[0-9]{4}([^0-9])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"), re.compile(r"\+?[0-9]{0,3}[^0-9]{0,2}[0-9]{3}[^0-9]{1,2}[0-9]{3}[^0-9][0-9]{4}$")
GROUPS_IDENTITY = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}$")
#: What stands before a name, as found quickly and as matched; then one to three capitalised words.
NAME_SIGNS = ("Mr", "Mrs", "Ms", "Miss", "Dr", "Prof", "Herr", "Frau", "Señor", "Monsieur", "Madame", "Mme", "name is", "Name:", "Dear", "heiße", "appelle", "llamo")
BEFORE_NAME = r"\b(?:(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Señora?|Monsieur|Madame|Mme)\b\.?|name is|Name:|Dear|heiße|appelle|llamo)\x20"
CAPITALISED = r"[^\W\d_a-zß-ÿ][^\W\d_]{1,30}"
CUED_NAME = re.compile(rf"{BEFORE_NAME}({CAPITALISED}(?:\x20{CAPITALISED}){{0,2}})")
TITLE_BEFORE, ANY_WORD = re.compile(rf"{BEFORE_NAME}$"), re.compile(r"[^\W\d_]+")
#: Street addresses: a number and a name of a street, or the other way round.
STREET_SIGNS = ("Street", "Road", "Avenue", "Lane", "Drive", "straße", "gasse", "rue ", "calle ", "Calle ")
STREET = re.compile(rf"(?<![\w.-])(?:[0-9]{{1,5}}\x20(?:{CAPITALISED}\x20){{1,3}}(?:Street|Road|Avenue|Lane|Drive)\b|[0-9]{{1,5}},?\x20rue\x20(?:de\x20|la\x20|du\x20){{0,2}}{CAPITALISED}|[^\W\d_a-zß-ÿ][^\W\d_]{{1,25}}(?:straße|gasse)\x20[0-9]{{1,4}}\b|[Cc]alle\x20{CAPITALISED},?\x20[0-9]{{1,4}}\b)")
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
CHAIN_GAP, SURE, EDGE_KINDS = 60, 0.9, 3
#: Message passing ends at this largest change of a message, or after so many rounds if it does not settle.
SETTLED, MOST_ROUNDS = 1e-4, 500
TRAINING_DOCUMENTS = 1500


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = (ord(c) - 48) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def small_parts(address: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in address.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their @ signs."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            end = m.end()
        else:
            end = max(end, at)
        at = text.find("@", max(end, at + 1))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, in order."""
    if not ANY.search(text):
        return []
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if small_parts(m[0])]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(out)


def names(text: str) -> list[tuple[int, int]]:
    """Names after a title or the like, and all other places of their words with a capital."""
    if not any(sign in text for sign in NAME_SIGNS):
        return []
    found = [m.span(1) for m in CUED_NAME.finditer(text)]
    if not found:
        return []
    words = {w for s, e in found for w in text[s:e].split()}
    run: list[tuple[int, int]] = []
    for m in ANY_WORD.finditer(text):
        if m[0] in words:
            if run and m.start() == run[-1][1] + 1 and text[run[-1][1]] == " ":
                run[-1] = (run[-1][0], m.end())
            else:
                run.append(m.span())
    return run


def units(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, str]]:
    """(start, end, base kind or -1, sort) of the base spans and of the other candidates, in order."""
    found = [(s, e, k, "mail" if k == 0 else "number") for s, k, e in base]
    taken = sorted((s, e) for s, e, *_ in found)
    others = [(*m.span(), "number") for m in NUMBER.finditer(text) if len(digits_of(m[0])) >= 7]
    if "@" in text or "at)" in text or "at]" in text:
        others += [(*m.span(), "mail") for m in VEILED.finditer(text)]
    others += [(s, e, "name") for s, e in names(text)]
    if any(sign in text for sign in STREET_SIGNS):
        others += [(*m.span(), "street") for m in STREET.finditer(text)]
    others += [(*m.span(), "account") for m in ACCOUNT.finditer(text)]
    k, reach, free = 0, -1, []
    for s, e, sort in sorted(others, key=lambda x: (x[0], -x[1])):
        while k < len(taken) and taken[k][0] < e:
            reach = max(reach, taken[k][1])
            k += 1
        if reach <= s:
            free.append((s, e, -1, sort))
            reach = e
    return sorted(found + free)


def account_valid(unit: str) -> bool:
    plain = unit.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def features(text: str, start: int, end: int, kind: int, sort: str, common: frozenset[str]) -> list[float]:
    """common: the words that the document also has without a capital."""
    unit = text[start:end]
    d, before = digits_of(unit), text[max(0, start - 24) : start]
    n, number, name = len(d), sort == "number", sort == "name"
    dotted = unit.count(".") == 3 and all(x.isdigit() for x in unit.split(".")) and small_parts(unit)
    return [
        1.0, *[float(kind == k) for k in range(4)], *[float(sort == x) for x in ("mail", "number", "name", "street", "account")], float(unit[0] == "+"),
        float(number and n < 7), float(number and 7 <= n <= 8), float(number and 9 <= n <= 11), float(number and 12 <= n <= 19), float(number and n > 19), float(number and 12 <= n <= 19 and luhn(d)), float(dotted),
        float(bool(GROUPS_CARD.match(unit))), float(bool(GROUPS_PHONE.match(unit))), float(bool(GROUPS_IDENTITY.match(unit))), float(sort == "account" and account_valid(unit)),
        *[float(not name and bool(c.search(before))) for c in CUES],
        float(name and bool(TITLE_BEFORE.search(before))), float(name and " " in unit), float(name and any(w.lower() in common for w in unit.split())),
        float(name and (not before.strip() or before.rstrip(" ")[-1] in ".!?\n")),
    ]


def keys(text: str, start: int, end: int, sort: str) -> tuple[str, list[str]]:
    """What a repeated unit shares, and what similar ones share."""
    unit = text[start:end]
    if sort == "mail":
        plain = re.sub(r"[\x20]?(?:\(at\)|\[at\])[\x20]?", "@", unit.lower())
        plain = re.sub(r"[\x20]?(?:\(dot\)|\[dot\])[\x20]?", ".", plain)
        return "@" + plain, ["@" + plain.split("@")[0]]
    if sort == "number":
        d = digits_of(unit)
        return d, [d[-7:]]
    plain = " ".join(unit.lower().split())
    return f"{sort} {plain}", [f"{sort} {w}" for w in plain.split()] if sort == "name" else []


def graph(text: str, found: list[tuple[int, int, int, str]]) -> tuple[list[tuple[int, int, int]], list[list[int]]]:
    """Edges (node, node, sort): 0 chain, 1 repeated, 2 similar; and the members of each hub, whose nodes follow the units'."""
    edges, held = [], {}
    for j, (s, e, _, sort) in enumerate(found):
        if j and s - found[j - 1][1] <= CHAIN_GAP:
            edges.append((j - 1, j, 0))
        same, near = keys(text, s, e, sort)
        held.setdefault((1, same), []).append((j, same))
        for x in dict.fromkeys(near):
            held.setdefault((2, x), []).append((j, same))
    hubs = []
    for (kind, _), members in held.items():
        if len(members) > 1 and (kind == 1 or len({same for _, same in members}) > 1):
            edges += [(j, len(found) + len(hubs), kind) for j, _ in members]
            hubs.append([j for j, _ in members])
    return edges, hubs


def described(text: str, found: list[tuple[int, int, int, str]]) -> list[list[float]]:
    common = frozenset(ANY_WORD.findall(text)) if any(sort == "name" for *_, sort in found) else frozenset()
    return [features(text, *u, common) for u in found]


def synthetic_documents(n: int, seed: int) -> Iterator[tuple[str, list[tuple[int, int, int]]]]:
    """Texts with known personal data, (start, end, label) with label 0 for a unit that is none."""
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice(("an", "er", "th", "in", "ol", "ma", "ri", "ke")) for _ in range(rng.randint(2, 3)))

    def card() -> str:
        body = "4" + num(14)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def account() -> str:
        body = num(18)
        rest = 98 - int(body + "131400") % 97
        return f"DE{rest:02d}{body}"

    grouped = lambda c, by: by.join((c[:4], c[4:8], c[8:12], c[12:]))
    for _ in range(n):
        parts, marks, at, used = [], [], 0, set()
        first, last, other = word().title(), word().title(), word()
        filler = ["the", "of", "and", "thion", "ered", other]
        secret = {1: f"{rng.choice(['ann', 'bo', 'carl'])}.{num(2)}@mail{num(1)}.example.com", 2: ".".join(str(rng.randrange(256)) for _ in range(4)), 3: card(), 4: f"+1 ({num(3)}) {num(3)}-{num(4)}", 7: account(), 8: f"{num(3)}-{num(2)}-{num(4)}"}
        for _ in range(rng.randint(1, 8)):
            label = rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 5, 6, 7, 8])
            cue = rng.choice(["", "", ["nr ", "e-mail ", "ip ", "card ", "phone ", "", "lives at ", "account ", "ssn "][label]])
            if label == 0:
                value, cue = rng.choice([num(rng.randint(7, 20)), f"{num(4)}-{num(2)}-{num(2)}", f"{num(5)} {num(6)}", f"{num(3)}-{num(2)}-{num(4)}", f"DE{num(20)}", other.title(), other.title(), grouped(card(), "/")]), rng.choice(["", "order ", "no ", "part "])
                if value[0].isalpha() and value[1].islower():  # a common word after a title, or at the start of a sentence
                    cue = "Dear " if not used & {0} else ". "
                    used.add(0)
                elif "/" in value:  # a reference that happens to pass as a card
                    cue = rng.choice(["ref ", "order ", ""])
                elif 12 <= len(digits_of(value)) <= 19 and luhn(digits_of(value)) or value[:2] == "DE" and account_valid(value):
                    continue
                elif GROUPS_IDENTITY.match(value):
                    cue = rng.choice(["order ", "part "])
            elif label == 1:
                value = rng.choice([secret[1], secret[1], secret[1].replace("@", " (at) ")])
            elif label == 2:
                value = secret[2]
            elif label == 3:
                c = secret[3]
                value = rng.choice([c, grouped(c, " "), grouped(c, ".")] + [grouped(c, "/")] * (2 if 3 in used else 0))
                used.add(3)
            elif label == 4:
                value = rng.choice([secret[4], secret[4], secret[4][3:]])
            elif label == 5:
                value, cue = (rng.choice([f"{first} {last}", last]), rng.choice(["Mr ", "Dr. ", "my name is ", "Mrs "])) if 5 not in used else (rng.choice([f"{first} {last}", last, last]), rng.choice(["", "", ". ", "Ms "]))
                used.add(5)
            elif label == 6:
                value = f"{rng.randint(1, 400)} {last} {rng.choice(['Street', 'Road', 'Avenue'])}"
            else:
                value = secret[label]
                cue = cue or (["account ", "ssn "][label - 7] if label == 8 and label not in used else "")
                used.add(label)
            lead = " ".join(rng.choice(filler) for _ in range(rng.randint(2, 14))) + " " + cue
            parts += [lead, value, " "]
            marks.append((at + len(lead), at + len(lead) + len(value), label))
            at += len(lead) + len(value) + 1
        yield "".join(parts), marks


def labelled(n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray, list, int]]:
    """Features, labels and edges of the nodes of each document, hubs last, and the number of units; a hub has its members' most frequent label."""
    out = []
    for text, marks in synthetic_documents(n, seed):
        found = units(text, base_spans(text))
        if found:
            y = [next((label for a, b, label in marks if a < e and s < b), 0) for s, e, *_ in found]
            edges, hubs = graph(text, found)
            x = np.array(described(text, found))
            x = np.concatenate([x, np.zeros((len(hubs), x.shape[1]))])
            out.append((x, np.array(y + [max(range(LABELS), key=[y[j] for j in h].count) for h in hubs]), edges, len(found)))
    return out


@cache
def trained(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Unary weights (features x labels) and edge weights (sort x label), by pseudo-likelihood with gradient ascent."""
    x, y, near = [], [], []
    for f, labels, edges, _ in labelled(TRAINING_DOCUMENTS, seed):
        count = np.zeros((len(labels), EDGE_KINDS, LABELS))
        for i, j, sort in edges:
            count[i, sort, labels[j]] += 1
            count[j, sort, labels[i]] += 1
        x.append(f), y.append(labels), near.append(count)
    x, y, near = np.concatenate(x), np.concatenate(y), np.concatenate(near)
    near = np.minimum(near, 3.0)  # a hub of very many members must not outweigh the rest of the fit
    w, v, target = np.zeros((x.shape[1], LABELS)), np.zeros((EDGE_KINDS, LABELS)), np.eye(LABELS)[y]
    for _ in range(350):
        score = x @ w + np.einsum("nsl,sl->nl", near, v)
        p = np.exp(score - score.max(1, keepdims=True))
        gap = target - p / p.sum(1, keepdims=True)
        w += 2.0 * (x.T @ gap / len(y) - 1e-4 * w)
        v += 2.0 * (np.einsum("nsl,nl->sl", near, gap) / len(y) - 1e-4 * v)
    return w, np.maximum(v, 0.0)


def marginals(unary: np.ndarray, edges: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Loopy sum-product until the messages settle: unary is nodes x labels in log form, edges are rows (i, j, sort)."""
    if len(edges):
        i, j = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        gain = np.expm1(np.concatenate([v[edges[:, 2]]] * 2))  # exp(v) - 1 where both ends agree
        m = np.zeros((len(i), unary.shape[1]))
        for _ in range(MOST_ROUNDS):
            belief = unary.copy()
            np.add.at(belief, j, m)
            h = belief[i] - m[back]
            h = np.exp(h - h.max(1, keepdims=True))
            new = np.log(h.sum(1, keepdims=True) + gain * h)
            new = 0.5 * m + 0.5 * (new - new.max(1, keepdims=True))
            moved, m = np.abs(new - m).max(), new
            if moved < SETTLED:
                break
        unary = unary.copy()
        np.add.at(unary, j, m)
    p = np.exp(unary - unary.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def find(texts: list[str | None], weights: tuple[np.ndarray, np.ndarray]) -> list[tuple[list, list]]:
    """For each text its base spans and all its spans, (start, kind, end), in order."""
    w, v = weights
    base = [base_spans(t or "") for t in texts]
    spans = [list(b) for b in base]
    for k, t in enumerate(texts):
        found = units(t, base[k]) if t else []
        if all(kind >= 0 for _, _, kind, _ in found):
            continue  # nothing to decide
        edges, hubs = graph(t, found)
        unary = np.concatenate([np.array(described(t, found)) @ w, np.zeros((len(hubs), LABELS))])
        for n, members in enumerate(hubs):
            certain = {found[j][2] for j in members if found[j][2] >= 0}
            if len(certain) == 1:  # a base match is certain, however many repeats look otherwise
                unary[len(found) + n] = np.where(np.arange(LABELS) == 1 + min(certain), 0.0, -50.0)
        p = marginals(unary, np.array(edges, dtype=np.int64).reshape(-1, 3), v)
        for (s, e, kind, _), q in zip(found, p[: len(found)], strict=True):
            label = int(q.argmax())
            if kind < 0 and label and q[label] >= SURE:
                spans[k].append((s, label - 1, e))
    return list(zip(base, map(sorted, spans), strict=True))


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"


def scan(docs: DataFrame) -> DataFrame:
    """Base counts, their digest, and all spans of each document with their number."""
    weights = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = find(b.column("text").to_pylist(), weights)
            n = [[sum(k == kind for _, k, _ in base) for base, _ in found] for kind in range(4)]
            digest = [hashlib.sha256(said(base).encode()).hexdigest() for base, _ in found]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(x, pa.int64()) for x in n], pa.array(digest, pa.string()), pa.array([said(x) for _, x in found], pa.string()), pa.array([len(x) for _, x in found], pa.int64())], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
