"""Secret scans: base patterns, and novelty of candidates by dictionary-primed zstandard."""

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Base patterns, by kind (fixed values).
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "novel")

LEAST = 16
NUMBER = re.compile(r"[0-9]{1,3}[^A-Za-z0-9]*\Z")
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.~-]{{{LEAST}}}")
RUN = re.compile(r"[A-Za-z0-9+/_=.~-]+")
#: A line break, real or escaped, and what stands between two lines of a key, quotes of joined strings included.
BREAK = r"(?:(?:\\+r)?\\+n|\r?\n)"
JOINED = r"[\"'][\x20\t]*[+,\\]?[\x20\t]*\r?\n[\x20\t]*[\"']"
GAP = re.compile(rf"(?:{JOINED}|{BREAK}[\x20\t]*(?:{JOINED})?)")
LINE = re.compile(GAP.pattern + r"(?!-----)([A-Za-z0-9+/_=.~-]++)(?=[\s\"'`\\<,;)}\]]|\Z)")
CLOSE = re.compile(GAP.pattern + "-----END")
#: What follows the words of a key's first line: the rest of it, header lines and blank ones.
HEADER = re.compile(rf"(?:\x20BLOCK)?-----{GAP.pattern}(?:[A-Za-z-]+:\x20[^\n\\]*{GAP.pattern})*(?:{GAP.pattern})*")
SENSITIVE = re.compile(r"pass(?:word|wd|phrase)?\b|pwd|secret|token|api[_-]?key|access[_-]?key|private[\x20_-]?key|auth|bearer|credential|signature|session[_-]?id", re.IGNORECASE | re.ASCII)
CUES = ("pass", "pwd", "secret", "token", "key", "auth", "bearer", "credential", "signature", "session")
#: Characters before a candidate that can make it sensitive, and around it that prime the compressor.
REACH, AROUND = 48, 256
#: Marginal compressed bytes for each byte of a candidate, from which it counts as novel.
NOVELTY = 0.55

#: What code around secrets usually says; names that are made of these compress well.
IDENTIFIERS = (
    "password passwd passphrase secret token apikey api_key access_key private_key public_key client_id client_secret authorization bearer basic "
    "credential credentials signature session_id session cookie username user login admin root host hostname localhost port database connection string url endpoint "
    "https://www.example.com/api/v1/users?page=1&limit=100 config configuration settings environment variable export default return function class import from self this "
    "null true false none undefined int str float bool list dict array object value name key id type data index count size length get set put post delete update insert select where "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000 1111111111 aaaaaaaa xxxxxxxx XXXXXXXX ________ -------- ======== "
    "example sample test dummy changeme placeholder your_token_here your_api_key_here insert_password_here "
)


class Novelty:
    """Marginal compressed bytes of a string against its surroundings and the identifier dictionary."""

    def __init__(self, dictionary: str = IDENTIFIERS, level: int = 9):
        prime = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=prime, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode("utf-8", "replace")))

    def marginal(self, text: str, start: int, end: int) -> float:
        """Added bytes for each byte of text[start:end], between what stands around it."""
        before, after = text[max(0, start - AROUND) : start], text[end : end + AROUND]
        return max(0, self.size(before + text[start:end] + after) - self.size(before + after)) / max(1, len(text[start:end].encode("utf-8", "replace")))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then by kind."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _mixed(x: str) -> bool:
    """Digits and letters, or letters of which three tenths at least are of each case, as names don't have. Up to three digits at the end are a name's number."""
    upper, lower = sum(c.isupper() for c in x), sum(c.islower() for c in x)
    return upper + lower > 0 and (any(c.isdigit() for c in NUMBER.sub("", x)) or min(upper, lower) >= 0.3 * (upper + lower))


def _key_end(text: str, start: int, end: int, headed: bool, novelty: Novelty) -> int:
    """The end of the key whose first line is text[start:end]: lines that directly follow it and are as long or novel, and a shorter last one."""
    full, lines = end - start, 1
    while m := LINE.match(text, end):
        size = len(m[1])
        if (headed and size == full) or (size >= LEAST and (size == full or _mixed(m[1])) and novelty.marginal(text, *m.span(1)) >= NOVELTY):
            end, lines = m.end(), lines + 1
            continue
        if size < full and (headed or lines > 1 or m[1].endswith("=") or CLOSE.match(text, m.end())):
            end = m.end()
        break
    return end


def _left(start: int, end: int, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What spans leave of [start, end)."""
    out = []
    for a, b in taken:  # by start
        if a < end and start < b:
            out.append((start, a))
            start = b
    return [(a, b) for a, b in [*out, (start, end)] if a < b]


def novel_spans(text: str, base: list[tuple[str, int, int]], novelty: Novelty) -> list[tuple[int, int, float]]:
    """(start, end, marginal bytes a byte) of incompressible strings after a sensitive word, without what base spans have of them.

    A candidate is a whole run of at least LEAST characters, however long, with digits and letters or letters of both cases. A sensitive
    word stands within REACH characters before it on its line, or in the first line of a private key. Key lines that directly follow,
    by real or escaped line breaks, belong to it. What a base span leaves of a candidate is measured by itself; a rest of
    under LEAST characters behind a base span goes by the whole run.
    """
    out, taken = [], sorted((a, b) for _, a, b in base)
    done = 0
    for cue in SENSITIVE.finditer(text):
        at, reach = max(cue.end(), done), cue.end() + REACH
        opened = text.rfind("-----BEGIN", max(0, cue.start() - REACH), cue.start())
        head = HEADER.match(text, cue.end()) if opened > text.rfind("-----END", max(0, cue.start() - REACH), cue.start()) else None
        headed = head is not None and head.end() >= done
        while True:
            if headed and at <= head.end():
                m = RUN.match(text, head.end())
            elif (m := CANDIDATE.search(text, at, reach + LEAST)) and (m.start() > reach or "\n" in text[cue.end() : m.start()]):
                m = None
            if m is None:
                break
            # the letter of an escaped break is no part of what follows
            start = m.start() + (m.start() > 0 and text[m.start() - 1] == "\\" and text[m.start()] in "nrt")
            end = RUN.match(text, m.start()).end()
            at = done = end
            if not headed and end - start < LEAST:
                continue
            whole = (headed or _mixed(text[start:end])) and (headed or novelty.marginal(text, start, end) >= NOVELTY)
            first = end
            if whole:
                at = done = end = _key_end(text, start, end, headed, novelty)
            headed = False
            overlapping = [(a, b) for a, b in taken if a < end and start < b]
            for a, b in _left(start, end, overlapping):
                if gap := GAP.match(text, a, b):
                    a = gap.end()
                value = novelty.marginal(text, a, b) if a < b else 0.0
                rest = whole and a < first and any(a == y for _, y in overlapping) and any(c.isalnum() for c in text[a:b])
                if (rest and b - a < LEAST) or (value >= NOVELTY and (b - a >= LEAST or b > first) and (_mixed(text[a:b]) or b > first)):
                    out.append((a, b, value))
    return out


def scan(text: str | None, novelty: Novelty) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], float]:
    """Base spans, all spans, and the greatest novelty of an added one."""
    text = text or ""
    low = text.lower()
    cued = any(x in low for x in CUES)
    if cued:
        base = base_spans(text)
    else:  # no assignment without one of its words
        base = sorted([("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20] * ("AKIA" in text) + [("hex", m.start(), m.end()) for m in HEX.finditer(text)], key=lambda s: (s[1], KINDS.index(s[0])))
    added = novel_spans(text, base, novelty) if cued else []
    spans = sorted([*base, *(("novel", a, b) for a, b, _ in added)], key=lambda s: (s[1], KINDS.index(s[0])))
    return base, spans, max((v for _, _, v in added), default=0.0)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """text with each run of overlapping spans replaced by mark."""
    out, at = [], 0
    runs: list[list[int]] = []
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    for a, b in runs:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


#: Rows that are scanned at a time: what a worker holds as Python strings stays small whatever the size of Arrow's batches.
SLICE = 256


def find_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", redacted: bool = False) -> DataFrame:
    """One row a document: doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans, max_novelty and, if wanted, redacted.

    Null and empty texts have no spans; a null text stays null when redacted. Whole texts are scanned, however long, and so are whole runs in them. Overlapping spans of different
    kinds are all kept; repeated rows give equal rows; null ids stay. An empty table gives no rows. Other columns, whatever their names, are ignored. One pass without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                rows: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans", "max_novelty", "redacted")}
                for value in part["text"].to_pylist():
                    base, spans, most = scan(value, novelty)
                    for kind in KINDS:
                        rows[f"n_{kind}"].append(sum(s[0] == kind for s in spans))
                    rows["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
                    rows["spans"].append(joined(spans))
                    rows["max_novelty"].append(most)
                    rows["redacted"].append((redact(value, spans) if spans else value) if redacted and value is not None else None)
                kinds = {"base_sha256": pa.string(), "spans": pa.string(), "max_novelty": pa.float64(), "redacted": pa.string()}
                names = [c for c in rows if redacted or c != "redacted"]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *[pa.array(rows[c], kinds.get(c, pa.int64())) for c in names]], names=["doc_id", *names])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, max_novelty double" + (", redacted string" if redacted else "")
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of `text` replaced by mark; all rows and other columns stay, also of clashing names. Null texts stay null, empty ones empty; an empty
    table gives no rows. Texts without a span pass as they are, in slices of SLICE rows through one pass without a shuffle."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                cleaned = [value if value is None or not (spans := scan(value, novelty)[1]) else redact(value, spans, mark) for value in part.column(at).to_pylist()]
                columns = part.columns
                columns[at] = pa.array(cleaned, part.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
