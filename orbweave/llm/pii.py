"""Personal data: fixed formats, and boosted trees over wider candidates.

Generators of high recall propose spans that may overlap; trees score each from
its format and the words around it; a calibrated threshold for each kind picks
those to redact. The trees are fitted on the driver to candidates drawn from
fixed templates (TRAINING_ROWS of them, seeded), not to the corpus. Templates come
in families of formats and phrases: trees learn from some, thresholds from another,
and one is left for tests.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orbweave.llm import boosting
from orbweave.llm.common import bounded_batches, clear_of, map_columns, texts

BASE_KINDS = ("email", "ip", "card", "phone")
#: Kinds in the order in which spans are listed; the last two come from candidates alone.
KINDS = (*BASE_KINDS, "ssn", "iban")
TRAINING_ROWS = 8000
#: Families of templates: for the trees, for the thresholds, for tests.
LEARNT, CALIBRATED, UNSEEN = (0, 1), (2,), 3
#: Candidates of one text that are scored at once.
SCORED = 10_000
#: Each kind's threshold is the lowest with this precision on the family for thresholds.
PRECISION = 0.98

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: The leftmost match begins where a run of digits does, so none of its other digits is tried.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: High-recall generators.
_GENERATORS = (
    ("email", re.compile(r"[\w.%+-]{1,64}@[\w-]{1,63}(?:\.[\w-]{1,63})+")),
    ("email", re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?[(\[](?:at|AT)[)\]]\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\.|[(\[](?:dot|DOT)[)\]])\s?[A-Za-z0-9-]{2,63}){1,4}")),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{0,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("ip", re.compile(r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?(?![\w:])")),
    ("card", re.compile(r"(?<![0-9])[0-9]{4}(?:[ ._-]?[0-9]{4}){2}[ ._-]?[0-9]{1,7}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+])\(?[0-9]{2,5}\)?(?:[ ./-]{1,2}[0-9]{2,8}){1,4}(?![0-9])")),
    ("phone", re.compile(r"(?<![0-9+.])0?[0-9]{9,11}(?![0-9.])")),
    ("ssn", re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")),
    ("iban", re.compile(r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Z0-9])")),
)
#: Dates and times as they stand in texts.
_DATE = re.compile(r"(?:(?:19|20)[0-9]{2}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./ ][0-9]{1,2}[-./ ](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[ -](?:19|20)[0-9]{2})(?![0-9])")
#: Words near a span that speak for its kind, or for something else.
_WORDS = {
    "email": ("mail", "contact", "write", "kontakt", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "addr", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "contact", "handy", "telefon", "móvil", "portable"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "other": ("order", "version", "isbn", "page", "score", "price", "model", "part", "invoice", "year", "section", "code", "ratio"),
}


_WORD_LIKE = re.compile(r"[A-Za-z]{2,}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four fixed formats, leftmost and non-overlapping for each."""
    found = []
    end, at = 0, text.find("@")
    while at >= 0:
        # A match has one @, with as many characters before it as are allowed.
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            found.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text) is None:
        return found
    if "." in text:
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if len(m[0]) >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans from all generators that can apply to the text."""
    if _DIGIT.search(text) is None and "@" not in text and "::" not in text and "(at)" not in (low := text.lower()) and "[at]" not in low:
        return []
    return [(kind, m.start(), m.end()) for kind, pattern in _GENERATORS for m in pattern.finditer(text)]


def _iban(span: str) -> bool:
    s = span.replace(" ", "")
    moved = s[4:] + s[:4]
    return moved.isalnum() and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of one candidate."""
    span = text[start:end]
    digits = _digits(span)
    before, after = text[max(0, start - 32) : start].lower(), text[end : end + 16].lower()
    groups = re.findall(r"[0-9]+", span)
    last = span.rpartition(".")[2]
    return [
        *(float(kind == k) for k in KINDS),
        len(span), len(digits), len(digits) / len(span), len(groups), max(map(len, groups), default=0), min(map(len, groups), default=0),
        float(luhn(digits)) if 13 <= len(digits) <= 19 else 0.0,
        float(_iban(span)) if kind == "iban" else 0.0,
        float("@" in span), float("(at)" in span.lower() or "[at]" in span.lower()), float(last.isalpha() and 2 <= len(last) <= 10),
        span.count("-"), span.count("."), span.count("/"), span.count(" "), span.count(":"), float("(" in span), float(span[0] == "0"),
        float(any(c in "ghijklmnopqrstuvwxyz" for c in span.lower())),
        float(any(w in before for w in _WORDS[kind])), float(any(w in after for w in _WORDS[kind])), float(any(w in before for w in _WORDS["other"])),
        float(len(groups) > 1 and len(groups[0]) == 4 and groups[0][:2] in ("19", "20")),
        float(_DATE.match(span) is not None), float("::" in span), len(_WORD_LIKE.findall(span)),
    ]


# What stands around a span (s) in each family; n is a word of its kind or another, w any word.
_FRAMES = (
    ("{w} {n}: {s} {w} {w}.", "{w} {w} {n} {s}, {w}", "{w} {s} {w}"),
    ("{w} ({n} {s}) {w}", "{n} is {s} {w}", "{w} {w} {s}. {w}"),
    ("{n}={s}; {w}", "{w} {w} {n} - {s} {w}", "{w} {n} {w} {s}"),
    ("{n}\n{s}\n{w}", "{w} {w}, {n} no. {s}, {w}", "{w}: {s} {w}"),
)
# Formats of each family, # for a digit. Personal numbers, numbers that other words stand by, and dates and times, which a word of any kind may stand by.
_PHONES = (("(###) ###-####", "###-###-####"), ("0# ## ## ## ##", "0#########", "### ### ####"), ("0## #######", "###.###.####", "0### ######"), ("(0##) ### ####", "###/###-####", "0####-#####"))
_NUMBERS = (("#########", "###-##", "## ##"), ("#### ####", "##########", "##/##"), ("###-###", "###########", "### ##"), ("## ### ##", "#####-##", "### ### ###"))
_DATES = (("20##-0#-1#", "1#/0#/20##", "20##-1#-0# 1#"), ("19##-20##", "1#.0#.20##", "1#.0#.20## 0#"), ("20##.1#.0#", "2#-0#-19##"), ("0# 1# 20##", "20##/0#/2# 1#"))


def _templates(rng: random.Random, family: int) -> tuple[str, str, int, int, int]:
    """A text with one candidate: (text, kind, start, end, whether it's personal)."""
    fill = lambda form: "".join(rng.choice("0123456789") if c == "#" else c for c in form)
    word = lambda: "".join(rng.choice("abcdefghilmnoprstu") for _ in range(rng.randint(3, 9)))
    groups = lambda n: [f"{rng.randrange(1 << 16):x}" for _ in range(n)]
    kind, own = rng.choice(KINDS), rng.random() < 0.5
    near, far = rng.choice(_WORDS[kind]), rng.choice((*_WORDS["other"], word(), word()))
    by_format = True  # whether the format tells, whatever stands by
    if kind == "email":
        dot = (".", " . ", " (dot) ", "(dot)")[family]
        span = f"{word()}.{word()}@{word()}.{rng.choice(('com', 'org', 'de', 'fr'))}" if rng.random() < 0.4 else f"{word()} {('(at)', '[at]')[family % 2]} {word()}{dot}{rng.choice(('com', 'net', 'es'))}"
        if not own:
            span = rng.choice((fill(f"{word()}@#.#.#"), fill(f"{word()} (at) {word()}.##"), fill(f"{word()}@{word()}.###"), fill(f"{word()}@###.#")))
    elif kind == "ip":
        if own:
            span = rng.choice((":".join(groups(8)), ":".join(groups(2)) + "::" + ":".join(groups(1 + family)), "fe80::" + ":".join(groups(1 + family))))
        else:
            span = rng.choice((":".join(fill("##") for _ in range(rng.randint(4, 6))), f"{rng.choice(('ad', 'be', 'face', 'a', 'c'))}::{rng.choice(('add', 'b', 'bad', 'f'))}", fill("1#:##:##:##"), "::"))
    elif kind == "card":
        while luhn(digits := rng.choice("3456") + fill("#" * 15)) != own:
            pass
        sep = (" ", "-", ".", "")[family]
        span = sep.join(digits[i : i + 4] for i in range(0, 16, 4))
    elif kind == "phone":
        dated = not own and rng.random() < 0.4
        span = fill(rng.choice(_PHONES[family] if own else _DATES[family] if dated else _NUMBERS[family]))
        by_format = dated
    elif kind == "ssn":
        span, by_format = fill("###-##-####"), False
    else:
        while True:
            country, body = rng.choice(("DE", "FR", "ES", "GB")), fill("#" * 18)
            check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
            span = f"{country}{check if own else (check + rng.randint(1, 90)) % 97:02d}{body}"
            if _iban(span) == own:
                break
        span = " ".join(span[i : i + 4] for i in range(0, len(span), 4)) if family % 2 else span
    said = near if own or (by_format and rng.random() < 0.5) else far
    frame = rng.choice(_FRAMES[family][:2] if not by_format else _FRAMES[family])
    if own and by_format and rng.random() < 0.5:
        said = far
    head, tail = re.sub(r"\{w\}", lambda _: word(), frame).replace("{n}", said).split("{s}")
    return head + span + tail, kind, len(head), len(head) + len(span), int(own)


def _drawn(rng: random.Random, families: tuple[int, ...], rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, labels and kinds of templates."""
    found = [_templates(rng, families[i % len(families)]) for i in range(rows)]
    return np.array([features(t, k, a, b) for t, k, a, b, _ in found]), np.array([own for *_, own in found], float), np.array([f[1] for f in found])


@functools.lru_cache(maxsize=1)
def trained(rows: int = TRAINING_ROWS, seed: int = 20) -> tuple[boosting.Boosted, dict[str, float]]:
    """Trees from half of the rows; each kind's least margin from the other half, of a family that the trees haven't met."""
    rng = random.Random(seed)
    x, y, _ = _drawn(rng, LEARNT, rows // 2)
    model = boosting.fit(x, y)
    x, y, kinds = _drawn(rng, CALIBRATED, rows // 2)
    return model, {kind: threshold(model.margin(x[kinds == kind]), y[kinds == kind]) for kind in KINDS}


def threshold(margin: np.ndarray, own: np.ndarray) -> float:
    """The lowest margin down to which PRECISION are personal, halfway to the next one below; infinite without any."""
    order = np.argsort(-margin, kind="stable")
    m, right = margin[order], np.cumsum(own[order])
    last = np.append(m[1:] < m[:-1], True)  # a threshold takes all of one margin
    precise = np.flatnonzero(last & (right / np.arange(1, len(m) + 1) >= PRECISION))
    if not len(precise):
        return np.inf
    at = int(precise[-1])
    return float(m[at] + m[at + 1]) / 2 if at + 1 < len(m) else float(m[at])


def find(text: str, model: boosting.Boosted, least: dict[str, float]) -> tuple[list, list]:
    """Base spans, and those with the chosen candidates; both by kind, then start."""
    base = base_spans(text)
    found = candidates(text)
    open_ = set(clear_of([c[1:] for c in found], [b[1:] for b in base]))
    free = [c for c in found if c[1:] in open_]
    chosen: list[tuple[str, int, int]] = []
    if free:
        margin = np.concatenate([model.margin(np.array([features(text, *c) for c in free[i : i + SCORED]])) for i in range(0, len(free), SCORED)])
        taken: list[tuple[int, int]] = []  # by start; they don't overlap
        for i in np.argsort(-margin, kind="stable").tolist():
            c = free[i]
            if margin[i] >= least[c[0]]:
                at = bisect.bisect_left(taken, c[1:])
                if (at == 0 or taken[at - 1][1] <= c[1]) and (at == len(taken) or c[2] <= taken[at][0]):
                    taken.insert(at, c[1:])
                    chosen.append(c)
    order = lambda s: (KINDS.index(s[0]), s[1])
    return sorted(base, key=order), sorted([*base, *chosen], key=order)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Personal data in whole texts: one row for each input row, repeated ones too.

    Returns the id column, n_email, n_ip, n_card, n_phone, base_sha256 (of the
    fixed formats' spans) and spans (those and chosen candidates). Offsets are
    code points, ends exclusive. A null text counts as empty: no spans, spans
    "". A null id stays null; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    model, least = trained()

    def make():
        def step(batch: pa.RecordBatch) -> dict[str, list]:
            out: dict[str, list] = {id_col: batch.column(id_col)} | {c: [] for c in (*(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans")}
            for text in texts(batch, text_col):
                base, spans = find(text, model, least)
                for k in BASE_KINDS:
                    out[f"n_{k}"].append(sum(s[0] == k for s in base))
                out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                out["spans"].append(joined(spans))
            return out

        return step

    return map_columns(docs.select(id_col, text_col), make, schema, text_col)


def redact_pii(docs: DataFrame, text_col: str = "text", mark: str = "[{}]") -> DataFrame:
    """The same rows with personal data in the text replaced by its kind; a null
    text stays null. All other columns stay as they are."""
    model, least = trained()

    def clean_one(text: str | None) -> str | None:
        if text is None:
            return None
        out, last = [], 0
        for kind, a, b in sorted(find(text, model, least)[1], key=lambda s: s[1:]):
            if a >= last:
                out += [text[last:a], mark.format(kind.upper())]
            last = max(last, b)
        return "".join([*out, text[last:]])

    @F.pandas_udf("string")
    def clean(column):
        return column.map(clean_one)

    return bounded_batches(docs).withColumn(text_col, clean(F.col(text_col)))
