"""Secret scan: fixed patterns, and two character Markov models.

Three kinds come from patterns (assignments, access keys, hexadecimal
runs). A fourth, ``markov``, weighs every long run of token characters:
one second-order character model is trained on random strings, one on
ordinary identifiers, and a run counts where the mean log-likelihood ratio
per character is above a threshold. All spans are in code points.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("assign", "access", "hex", "markov")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST, TOKEN_LEAST = 6, 20, 24, 20
#: Mean log-likelihood ratio per character (nats) from which a run is random.
THRESHOLD = 0.6

_TOKEN_CHARS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_IS_HEX = bytes(120 if b in b"0123456789abcdef" else 32 for b in range(256))
_IS_TOKEN = bytes(120 if b in _TOKEN_CHARS else 32 for b in range(256))
_CODE = {c: i for i, c in enumerate(_TOKEN_CHARS.decode())}
_N = len(_CODE)


def runs(raw: bytes, table: bytes, least: int) -> list[tuple[int, int]]:
    """Bounds of maximal runs, at least so long, of the bytes marked in the table."""
    marks, needle, found, at = raw.translate(table), b"x" * least, [], 0
    while (start := marks.find(needle, at)) >= 0:
        end = marks.find(b" ", start)
        end = len(marks) if end < 0 else end
        found.append((start, end))
        at = end
    return found


class CharModel:
    """Second-order Markov model over token characters, add-``alpha`` smoothed."""

    def __init__(self, alpha: float = 0.2):
        self.alpha, self.counts, self.totals = alpha, Counter(), Counter()

    def fit(self, samples: Iterable[str]) -> CharModel:
        for s in samples:
            codes = [_N, _N, *(_CODE[c] for c in s if c in _CODE)]
            for a, b, c in zip(codes, codes[1:], codes[2:]):
                # The whole history backs off to the last character alone.
                for key in ((a, b), (b,)):
                    self.counts[key, c] += 1
                    self.totals[key] += 1
        return self

    def log_likelihood(self, s: str) -> float:
        codes, total = [_N, _N, *(_CODE[c] for c in s)], 0.0
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            p = (self.counts[(b,), c] + self.alpha) / (self.totals[(b,)] + self.alpha * _N)
            p = (self.counts[(a, b), c] + 4 * p) / (self.totals[(a, b)] + 4)
            total += math.log(p)
        return total


# Words that ordinary identifiers are made of.
IDENTIFIER_WORDS = (
    "get set add remove update delete create load store read write open close parse format encode decode build init start stop run "
    "test check find search sort filter map reduce merge split join count index value key name list item node tree graph path file "
    "line text string number date time user group role account order customer product price total amount status state config option "
    "default handler manager factory service client server request response message event queue stack buffer cache table column row "
    "query result error exception debug info warning trace log level session token model view controller template component module "
    "package version release license project document section chapter title author abstract reference introduction conclusion "
    "information international organization development government understanding relationship responsibility characteristic"
).split()


def labelled_samples(n: int = 4000, seed: int = 7) -> list[tuple[str, str]]:
    """(text, label) rows: ``random`` strings and ``ordinary`` identifiers by rule."""
    rng, out = random.Random(seed), []
    alphabets = ("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", _TOKEN_CHARS.decode())
    for i in range(n):
        out.append(("".join(rng.choices(alphabets[i % 4], k=rng.randint(20, 64))), "random"))
        words = rng.choices(IDENTIFIER_WORDS, k=rng.randint(2, 6))
        style = i % 5
        text = ("_".join(words) if style == 0 else "".join(w.title() for w in words) if style == 1 else "-".join(words) if style == 2
                else "/".join(words) if style == 3 else "_".join(words).upper())
        out.append((text + (str(rng.randint(0, 2030)) if i % 3 == 0 else ""), "ordinary"))
    return out


# Parts that long words of several languages are made of.
WORD_PARTS = (
    "anti auto bio counter de dis electro ex for fore hyper im in inter ir micro mis multi non over para photo poly post pre pro pseudo psycho re semi sub super tele thermo trans ultra un under "
    "able al ance and ate ation ed ence ent er ers ful fully hood ian ible ic ical ification ing ings ism ist istic ity ization less ly ment ness ology on or ous ship sion the that tion ward "
    "act andre cal cept cha char ci clin comp cred dem dict duct fact flex form gram graph her his hon ject lead light log man mand mark med mit mort nect on ory port pos pri rect rupt scope scrib sect sing spect stand str struct ten tend th tract tri vent vers vis vol was water wh with wr "
    "ab an auf aus be bei berg bewerb bund burg chen der die durch eigen ein einen en ent er erb ern es feld fahrt ge gegen geld gesell hand haupt haus heit ich ig isch keit kraft land lei lich licher lichkeit lung mit nach ober recht reich sch schaft schau schein schlag sicher staat steuer stand sprach tum ung ungs unter ver verfahr ver vor wald weg weise werk wesen wirtschaft wort zeit zer zeug zu zusammen zwischen pf tz cht "
    "ai ais ait age aire aison ant au aux ce cha con dans de des ette eau eaux elle elles ement ent et eur eurs eux fran gouverne ille ir isation issant je la les leur lieu lle mes mais ne nous on ont oi oire ou ouille our ous par plus pour que qui re se sur teur tion tre un une vous "
    "ado ador ales ando ar aria ario as asi car cion ciones con cual cuando dad dades de del desa el ella en entre era ero es esta iendo ion ismo ista la las llo los mente mento miento mos muy no os oso para pero por que quier rro se ser sin sobre tad tar tra trans una uno vez y"
).split()


def letter_samples(n: int = 8000, seed: int = 11) -> list[tuple[str, str]]:
    """(text, label) rows without digits: ``random`` letters, ``ordinary`` long
    words by rule, and the rulers (one or two characters repeated) of texts."""
    rng, out = random.Random(seed), []
    lower = "abcdefghijklmnopqrstuvwxyz"
    alphabets = (lower, lower.upper(), lower + lower.upper())
    for i in range(n):
        out.append(("".join(rng.choices(alphabets[i % 3], k=rng.randint(20, 64))), "random"))
        word, least = "", rng.randint(20, 40)
        while len(word) < least:
            word += rng.choice(WORD_PARTS)
        out.append((word.title() if i % 4 == 1 else word.upper() if i % 4 == 2 else word, "ordinary"))
        if i % 4 == 0:
            out.append(("".join(rng.choices(_TOKEN_CHARS.decode(), k=rng.choice((1, 1, 2)))) * 20, "ordinary"))
    return out


def train(samples: Iterable[tuple[str, str]]) -> tuple[CharModel, CharModel]:
    """Models of the rows labelled ``random`` and ``ordinary``."""
    rows = list(samples)
    return tuple(CharModel().fit(t for t, label in rows if label == kind) for kind in ("random", "ordinary"))


class SecretScanner:
    def __init__(self, models: tuple[CharModel, CharModel] | None = None, threshold: float = THRESHOLD):
        self.random, self.ordinary = models or train(labelled_samples() + letter_samples())
        self.threshold = threshold

    def ratio(self, s: str) -> float:
        """Mean log-likelihood ratio per character: random against ordinary."""
        return (self.random.log_likelihood(s) - self.ordinary.log_likelihood(s)) / max(1, len(s))

    def scan(self, text: str | None) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind."""
        if not text:
            return []
        raw = text.encode("utf-8", "surrogatepass")
        spans: list[tuple[str, int, int]] = []
        low = raw.lower()
        if any(k in low for k in _KEYWORDS):
            spans += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        if b"AKIA" in raw:
            spans += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
        ascii_only = len(raw) == len(text)

        def pointed(found: list[tuple[int, int]]) -> Iterable[tuple[int, int, int]]:
            """Code point and byte bounds of runs, counted on from run to run."""
            point = byte = 0
            for start, end in found:
                point += start - byte if ascii_only else len(raw[byte:start].decode("utf-8", "surrogatepass"))
                byte = start
                yield point, start, end

        spans += [("hex", at, at + end - start) for at, start, end in pointed(runs(raw, _IS_HEX, HEX_LEAST))]
        base = sorted((a, b) for _, a, b in spans)
        starts, furthest = [a for a, _ in base], list(accumulate((b for _, b in base), max))
        for at, start, end in pointed(runs(raw, _IS_TOKEN, TOKEN_LEAST)):
            stop = at + end - start
            # A run that lies in a pattern's span, or holds one, is taken already.
            first, last = bisect_left(starts, at), bisect_right(starts, at)
            covered = last and furthest[last - 1] >= stop
            if not covered and not any(b <= stop for _, b in base[first : bisect_left(starts, stop)]) and self.ratio(raw[start:end].decode()) >= self.threshold:
                spans.append(("markov", at, stop))
        return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def written(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


SCHEMA = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_markov long"


def scan_secrets(docs: DataFrame, models: tuple[CharModel, CharModel] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document with its secret spans.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored, null
    ids stay, null text is the empty text (no spans), repeated rows give
    repeated results. Each whole text is scanned in its task; no shuffle.
    """
    kept = docs.select("doc_id", "text")
    schema = T.StructType([kept.schema["doc_id"], *T.StructType.fromDDL(SCHEMA).fields])

    def run(batches: Iterable):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        target, scanner = to_arrow_schema(schema), SecretScanner(models, threshold)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                spans = scanner.scan(text.as_py())
                kinds = Counter(k for k, _, _ in spans)
                base = written(s for s in spans if s[0] != "markov")
                rows.append((kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(base.encode()).hexdigest(), written(spans), kinds["markov"]))
            columns = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0)] + [pa.array(c, f.type) for c, f in zip(columns, list(target)[1:])], schema=target)

    return kept.mapInArrow(run, schema)
