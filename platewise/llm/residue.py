"""Template residue, filler and error-page mail.

The writer's own part of every mail (no quoted mail) is read once into the places of a feature space of hashed n-grams, title words and lengths, and into a weak label: the rule (a
response status, a phrase, an open field, filler) that takes the part for residue, if any. A logistic regression with L2 penalty is trained on a bounded sample of labelled rows. Its cut is
set on mail of hosts that its first fit has not seen; then it scores every document and decides. Rules are labels only: none of them, nor a mark made by them, is a feature.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from platewise.llm.mail import mail_parts, own_lines
from platewise.session import materialize

# Words and patterns of the four languages of the archive.
_CLOSING = re.compile(
    r"(?i)^\s*(?:with best wishes|(?:kind|best|warm) regards|regards|best|cheers|(?:many )?thanks|sincerely|yours|mit freundliche[nm] gr(?:u|ü)(?:ss|ß)(?:en)?|(?:viele|beste) grüsse?|viele grüße|danke und gruss|"
    r"gruss|bien à vous|cordialement|merci|saludos(?: cordiales)?|un saludo|gracias|atentamente)\s*,?\s*$|^-- ?$"
)
_GREETING = re.compile(r"(?i)^\s*(?:dear|hi|hello|hey|good (?:morning|day|evening)|hallo|liebe[r]?|guten (?:tag|morgen)|sehr geehrte[r]?|hola|estimad[oa]s?|buenos días|cher|chère|bonjour)\b.{0,70}[,:!]?\s*$")
#: Parts of disclaimers and footers.
_DISCLAIMER = re.compile(
    r"(?i)\b(?:addressee|intended recipient|views (?:expressed )?in this (?:mail|message)|(?:consider|think about|think of) the (?:environment|forests?|trees?)|registered office|(?:excuse|pardon) (?:the|my) (?:brevity|typos)|"
    r"nur für den empfänger|réservé à son destinataire|solo para su destinatario|sent from|enviado desde|envoyé depuis|gesendet|archived copy)"
)
#: How disclaimers and footers begin; such a line starts a paragraph of its own even where the blank line before it was lost.
_DISCLAIMER_START = re.compile(
    r"(?i)(?:this message and its attachments|the views (?:expressed )?in this|please (?:consider|think)|our registered office|sent from|diese nachricht ist nur|ce message est réservé|este mensaje es solo|"
    r"enviado desde|envoyé depuis|gesendet|-- archived|archived copy)"
)
_FUNCTION_WORDS = frozenset(
    "the a an and or of to in on for with is was are be it this that you your i we our my he she they as at by from not but if so can could would please have has had will there who what when which "
    "der die das und oder ist war sind ein eine einen zu im in den dem mit von für nicht auf wir ich sie es hat haben wurde bitte dass weil wenn bei kannst noch aus "
    "le la les un une des et ou est sont a été de du dans pour avec que qui ne pas nous vous il elle si au sur merci je ce cette son sa "
    "el los las una y o es son fue en con para por no nos su se lo al hasta porque si tenemos la está este esta".split()
)
_FIELD = re.compile(
    r"\{\{[^{}]+\}\}|[$#]\{\w[^{}]*\}|<%=?[^%]+%>|%\([A-Za-z_][\w ]*\)s|%%\w[\w ]*%%|@@\w[\w ]*@@|(?<!\w)__[A-Za-z][A-Za-z_ ]*__(?!\w)|\*\|[^|]+\|\*|"
    r"«\w[\w ]*»|<<\w[\w .]*>>|<insert [^<>]+>|\[\[\w[^\[\]]*\]\]|\[(?:your|insert|bitte|please|enter|votre|insérer|su|introduzca|ihr[e]?)\b[^\[\]]+\]|"
    r"\[[A-Z][a-z]+(?:_[A-Z]?[a-z]+)*\]|\{\d\}",
    re.IGNORECASE,
)
_FIELD_HINT = re.compile(r"[{\[<%@_*«]")
_EMPTY_HINTS = ("null", "none", "undefined", "nan", "n/a", " ,", " :", " is and", " ist ,", " es y", " est et", "contact", "kontakt")
_PLAIN_BRACKET = re.compile(r"\[[A-Z][a-z]+(?:_[A-Z][a-z]+)*\]\Z")
_EMPTY_FIELD = re.compile(
    r"(?im)^\s*(?:dear|hi|hello|good morning|hallo|liebe[r]?|guten tag|hola|estimad[oa]|cher|chère|bonjour|buenos días)\s+(?:(?:null|none|undefined|nan|n/a)(?:\s+(?:null|none|undefined|nan|n/a))*\s*)?[,:!]|"
    r"(?:reference is|zeichen ist|referencia es|référence est)\s+(?:and|,|y|et|null|none|undefined|nan|n/a)\b|"
    r"^\s*(?:contact|kontakt|contacto)\s*:\s*(?:null|none|undefined|nan|n/a)?\s*$"
)
_PLAIN_GREETING = re.compile(r"(?i)^\s*(?:hi|hello|hallo|hola|bonjour|good morning|guten tag|buenos días)[,:!]\s*$")
#: Code and quotation in running text; two marks further apart than a sentence are not taken for a pair, or a stray one would hide the text between.
_CODE = re.compile(r"`[^`]{0,200}`|\"[^\"\n]{0,200}\"|„[^“”]{0,200}[“”]|“[^”]{0,200}”")
_STATUS = re.compile(
    r"(?i)\b[45]\d\d\b[^.]{0,20}\b(?:not found|forbidden|bad gateway|gateway|internal|unavailable|timeout|error|unauthorized|gone)\b|\b(?:status|code|error|erreur|fehler)\s*:?\s*[45]\d\d\b|"
    r"traceback \(most recent|^\s*file \"[^\"]+\", line \d+|\b(?:java|javax|org|com)\.[\w.]+(?:exception|error)\b|^\s*at [\w.$]+\([\w.]+(?::\d+)?\)|^\s*\w*(?:error|exception): '?\w+|"
    r"<h1>|<title>|^\w[\w-]*/\d+\.\d+$"
)
_ERROR = re.compile(
    r"(?i)something went wrong|request id\b|incident number|too many (?:requests|connections)|query failed|(?:link|connection) to the database|database connection|did not answer in time|down for maintenance|"
    r"access denied|lack the rights|session has (?:run out|expired)|sign in again|no longer held|has moved or was deleted|page you asked for|could not be (?:served|found|opened) by|page introuvable|seite wurde nicht gefunden|"
    r"página no (?:existe|encontrada)|no se encontró|try again in a few|service unavailable|zugriff verweigert|accès refusé|acceso denegado|not be reached|server said"
)
_SCRIPT = re.compile(
    r"(?i)javascript (?:is |ist |est )?(?:disabled|off|turned off|deaktiviert|désactivé)|(?:switch on|enable|activate|turn on|aktivieren sie|activer|active|activez|habilite) (?:cookies and )?javascript|<noscript|"
    r"(?:page|viewer|view|mailbox|site) (?:needs|requires) scripts|without (?:active )?scripting|does not work without scripts|turned off\W*$|browser blockiert skripte|exige des scripts|bloquea los scripts|"
    r"^(?:please|kindly|you must|bitte|veuillez)?\s*(?:allow it and reload|reload)\b"
)
_CONTROL = re.compile(r"(?i)^(?:reload|loading\W*|back to the inbox|home|login|ok|retry|try again|neu laden|recharger|recargar|cargando\W*|chargement\W*)\W*$")
_PLACEHOLDER = re.compile(
    r"(?i)lorem ipsum|(?:your|votre|ihr|su) (?:text|texte|texto)\b.{0,12}(?:here|ici|hier|aquí)|click to edit|headline of the section|only a sample|dummy copy|body copy to follow|write something here|"
    r"add a description in|d'exemple à remplacer|de muestra|blindtext, bitte|überschrift einfügen|texto de relleno|insert (?:text|title) here"
)
#: Words of the standard filler paragraph.
_LATIN = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip "
    "ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
_TOKEN = re.compile(r"[^\W_]+|[{}\[\]<>%@#*|«»`_]{2,}")
_LETTERS = re.compile(r"[^\W\d_]+")
_NUMERIC_LINE = re.compile(r"^[\W\d_]*$")


@dataclass
class OwnPart:
    """A mail's own part: all its lines (the greeting too), its sentences without greeting and disclaimers, and whether a field was left unfilled."""

    lines: list[str]
    sentences: list[str]
    field: bool

    def __post_init__(self) -> None:
        #: The letter words of every sentence, in folded case.
        self.words = [_LETTERS.findall(s.casefold()) for s in self.sentences]
        self.n_words = sum(map(len, self.words))


def _unfilled(text: str) -> bool:
    """Whether a field was left open, or filled with an empty value, outside code and quotation."""
    if _FIELD_HINT.search(text):
        for m in _FIELD.finditer(_CODE.sub(" ", text)):
            found = m.group()
            if found[0] == "[" and found[1] != "[" and " " not in found and not _PLAIN_BRACKET.match(found):
                continue
            return True
    low = text.lower()
    if any(hint in low for hint in _EMPTY_HINTS):
        return any(not _PLAIN_GREETING.match(m.group()) for m in _EMPTY_FIELD.finditer(_CODE.sub(" ", text)))
    return False


def _disclaims(text: str) -> bool:
    return _DISCLAIMER.search(text) is not None


def read_own_part(raw: str | None) -> OwnPart:
    """Own sentences of all shown parts (each different sentence of alternative parts once per part) and the field mark."""
    shown: list[str] = []
    sentences: list[str] = []
    field = False
    for kind, text in mail_parts(raw):
        if kind == "html":
            text = re.sub(r"(?i)</?(?:code|tt|kbd|samp)\b[^>]*>", "`", text)
        lines = own_lines(kind, text)
        shown.extend(line for line in lines if line.strip())
        paragraphs: list[str] = []
        block: list[str] = []
        first, signed = True, False
        for line in [*lines, ""]:
            bare = line.strip()
            if not bare:
                if block:
                    paragraphs.append(" ".join(block))
                    block = []
                continue
            if len(bare) < 48 and _CLOSING.match(bare):
                if block:
                    paragraphs.append(" ".join(block))
                    block = []
                signed = True
                continue
            if first:
                first = False
                named = (len(bare) < 30 and bare[-1] in ",:") or (len(bare.split()) <= 3 and bare.istitle())
                if _GREETING.match(bare) or (named and not _is_residue(bare, _LETTERS.findall(bare.casefold()))):
                    field = field or _unfilled(bare)
                    continue
            if signed and len(bare) < 60 and bare[-1] not in ".!?" and len(bare.split()) <= 6:
                field = field or _unfilled(bare)
                continue  # name, telephone, address below the closing
            if block and _DISCLAIMER_START.match(bare):
                paragraphs.append(" ".join(block))
                block = []
            block.append(bare)
        if not field and paragraphs:
            field = _unfilled("\n".join(paragraphs))
        for paragraph in paragraphs:
            parts = _SENTENCE_END.split(paragraph)
            if len(paragraph) < 400 and _disclaims(paragraph):
                parts = [s for s in parts if not _disclaims(s)]
                if sum(map(len, parts)) < 15:
                    continue
            sentences.extend(s for s in parts if s.strip())
    return OwnPart(shown, sentences, field)


def _is_latin(words: list[str]) -> bool:
    """Whether nearly all words are those of the standard filler paragraph."""
    return len(words) >= 4 and sum(x in _LATIN for x in words) >= 0.8 * len(words)


def _is_repeated(own: OwnPart) -> bool:
    """One sentence over and over; two that alternate must come more often than alternative parts of one mail repeat them."""
    n = len(own.sentences)
    if n < 4:
        return False
    distinct: set[str] = set()
    for s, w in zip(own.sentences, own.words):
        if not _NUMERIC_LINE.match(s):
            distinct.add(" ".join(w))
            if len(distinct) > 2:
                return False
    return len(distinct) == 1 or (n >= 8 and len(distinct) == 2)


# Every match of a rule holds one of its hints: looking for them first spares ordinary sentences the patterns.
_STATUS_HINT = re.compile(r"[45]\d\d")
_STATUS_HINTS = ("traceback", 'file "', "exception", "error", "<h1>", "<title>", "/", "(")
_ERROR_HINTS = (
    "went wrong", "request id", "incident number", "too many", "query failed", "database", "in time", "maintenance", "access denied", "the rights", "session has", "sign in", "no longer held", "was deleted",
    "you asked", "could not be", "introuvable", "nicht gefunden", "no existe", "no encontrada", "se encontró", "try again", "unavailable", "verweigert", "refusé", "denegado", "not be reached", "server said",
)
_SCRIPT_HINTS = ("script", "skript", "turned off", "reload", "allow it")
_PLACEHOLDER_HINTS = (
    "lorem", "text", "click to edit", "headline of", "sample", "dummy copy", "body copy", "something here", "description in", "exemple", "muestra", "überschrift", "title here",
)


def _status(s: str, low: str) -> bool:
    return (_STATUS_HINT.search(low) is not None or any(h in low for h in _STATUS_HINTS)) and _STATUS.search(s) is not None


def _script(s: str, low: str) -> bool:
    return any(h in low for h in _SCRIPT_HINTS) and _SCRIPT.search(s) is not None


def _error(s: str, low: str) -> bool:
    return (len(s) < 60 and _CONTROL.match(s) is not None) or (any(h in low for h in _ERROR_HINTS) and _ERROR.search(s) is not None)


def _placeholder(s: str, low: str) -> bool:
    return any(h in low for h in _PLACEHOLDER_HINTS) and _PLACEHOLDER.search(s) is not None


#: Body rules by family, each of which can be held out of the weak labels.
_FAMILIES = {"status": _status, "script": _script, "error": _error, "placeholder": _placeholder}


def _is_residue(sentence: str, words: list[str]) -> bool:
    low = sentence.lower()
    return _is_latin(words) or any(test(sentence, low) for test in _FAMILIES.values())


def is_ordinary(sentence: str, words: list[str]) -> bool:
    """A sentence somebody wrote: some words, held together by function words, that is not itself residue."""
    return len(words) >= 3 and not _FUNCTION_WORDS.isdisjoint(words) and not _is_residue(sentence, words)


def _is_filler(own: OwnPart) -> bool:
    w = [x for s, words in zip(own.sentences, own.words) if not _NUMERIC_LINE.match(s) for x in words]
    return len(w) >= 4 and (not any(x in _FUNCTION_WORDS for x in w) or len(set(w)) <= max(4, len(w) // 4))


def prose_share(own: OwnPart) -> float:
    """Share of function words of the four languages among the words of the sentences; 0 without words. Somebody's own words have a good third."""
    return sum(x in _FUNCTION_WORDS for w in own.words for x in w) / own.n_words if own.n_words else 0.0


def _named_family(own: OwnPart) -> str | None:
    """The first family with a rule that one of the sentences fits."""
    for name, test in _FAMILIES.items():
        if any(test(s, s.lower()) for s in own.sentences) or (name == "placeholder" and any(map(_is_latin, own.words))):
            return name
    return None


def weak_family(own: OwnPart) -> str | None:
    """The weak label: the family of the rule that takes the part for residue, or None. Body rules ask that no sentence is ordinary; repetition counts whatever is repeated, and
    many words with hardly a function word among them are filler, which may hold one by accident."""
    if own.field:
        return "field"
    if _is_repeated(own):
        return "repeated"
    if own.n_words >= 8 and prose_share(own) < 0.1:
        return _named_family(own) or "filler"
    if not own.sentences or any(map(is_ordinary, own.sentences, own.words)):
        return None
    if name := _named_family(own):
        return name
    return "filler" if (len(own.sentences) >= 4 and len(set(own.sentences)) <= 2) or _is_filler(own) else None


# ---------------------------------------------------------------------------------------------------------------------
# Features: places in one space of hashed n-grams, title words and lengths
# ---------------------------------------------------------------------------------------------------------------------

GRAMS, TITLES, LENGTHS = 1 << 16, 1 << 10, 64
SIZE = GRAMS + TITLES + LENGTHS
_PIECE = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+|\n")
_QUOTED = re.compile(r"`[^`]*`|\"[^\"\n]*\"|„[^“”\n]*[“”]|“[^”\n]*”")
_QUOTE_HINT = re.compile(r"[`\"„“]")
#: Something between marks of any kind: a gram of the shape alone, whatever stands inside.
_ENCLOSED = re.compile(r"([^\w\s.,;:!?'\"()-]{1,3}) ?([^\W_][\w .|]*?) ?([^\w\s.,;:!?'\"()-]{1,3})|(?<![^\W_])(__)([^\W_][^\W_ ]*(?:[_ ][^\W_]+)*)(__)")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    """A number per token that is the same in every process; a run of digits counts by its length."""

    def __missing__(self, token: str) -> int:
        data = (f"#{len(token)}" if token.isdigit() else token).encode("utf-8", "replace")
        self[token] = h = zlib.crc32(data) << 32 | zlib.crc32(data, 0x5BD1E995)
        return h


_hashes = _Hashes()


def _pieces(text: str) -> list[str]:
    """Words, numbers, runs of marks and line ends; what stands in quotation or code is told apart by a prefix."""
    if not _QUOTE_HINT.search(text):
        return _PIECE.findall(text)
    out: list[str] = []
    at = 0
    for m in _QUOTED.finditer(text):
        out.extend(_PIECE.findall(text[at : m.start()]))
        out.extend("q:" + x for x in _PIECE.findall(m.group()[1:-1]))
        at = m.end()
    out.extend(_PIECE.findall(text[at:]))
    return out


def _shapes(text: str) -> list[str]:
    """Grams of what stands between marks outside quotation and code: by the marks, and by whether it is a number."""
    if not _FIELD_HINT.search(text):
        return []
    out = []
    for m in _ENCLOSED.finditer(_QUOTED.sub(" ", text.replace("\n", " "))):
        left, inside, right = m.group(1, 2, 3) if m.group(1) else m.group(4, 5, 6)
        kind = "#" if inside.isdigit() else "a"
        out.extend((f"shape:{left}{kind}{right}", f"shape:{left[:1]}{kind}", f"shape:{len(left)}{kind}{len(right)}"))
    return out


def feature_places(own: OwnPart, subject: str | None) -> list[int]:
    """Occupied places of the feature space: hashed n-grams (one and two pieces, line ends among them; shapes), title words, and lengths of the part. Each once."""
    if len(_hashes) > 300_000:
        _hashes.clear()
    text = "\n".join(["", *own.lines, ""])
    pieces = _pieces(text.casefold())
    h = np.fromiter(map(_hashes.__getitem__, pieces), dtype=np.uint64, count=len(pieces))
    shapes = np.array([_hashes[x] for x in _shapes(text)], dtype=np.uint64)
    grams = np.unique(np.concatenate((h, h[:-1] * _MIX + h[1:], shapes)) % np.uint64(GRAMS)).astype(np.int64).tolist()
    title = sorted({GRAMS + _hashes[w] % TITLES for w in _PIECE.findall(subject.casefold())}) if isinstance(subject, str) else []
    base = GRAMS + TITLES
    lengths = [base + min(31, int(2 * math.log2(1 + len(pieces)))), base + 32 + min(15, int(2 * math.log2(1 + len(own.lines)))), base + 48 + min(15, int(2 * math.log2(1 + len(title))))]
    return [*grams, *title, *lengths]


_READ = "doc_id {0}, host string, places array<int>, family string, prose double, n_words int"


def read_documents(documents: DataFrame) -> DataFrame:
    """One row per document with the feature places and the weak label of its own part; whole texts, read once. Null and empty texts have a length and no label."""
    schema = _READ.format(documents.schema["doc_id"].dataType.simpleString())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for doc, raw, sender, subject in zip(pdf["doc_id"], pdf["text"], pdf["from_addr"], pdf["subject"]):
                own = read_own_part(raw if isinstance(raw, str) else None)
                host = sender.rpartition("@")[2].strip().lower() if isinstance(sender, str) else ""
                rows.append((doc, host, feature_places(own, subject), weak_family(own), prose_share(own), own.n_words))
            yield pd.DataFrame(rows, columns=["doc_id", "host", "places", "family", "prose", "n_words"])

    return documents.select("doc_id", "text", "from_addr", "subject").mapInPandas(read, schema)


@F.udf(returnType=VectorUDT())
def _vector(places):
    return Vectors.sparse(SIZE, places, [1.0] * len(places))


def probability(places: Column, weights: Broadcast, intercept: float) -> Column:
    """The classifier's answer from the places alone: one gather and sum over an Arrow batch."""

    @F.arrow_udf("double")
    def score(batch: pa.Array) -> pa.Array:
        sizes = np.diff(batch.offsets.to_numpy())
        row = np.repeat(np.arange(len(batch)), sizes)
        total = np.bincount(row, weights.value[batch.flatten().to_numpy(zero_copy_only=False)], len(batch)) + intercept
        return pa.array(1 / (1 + np.exp(-np.clip(total, -500, 500))))

    return score(places)


@dataclass
class ResidueModel:
    """A weight per place, the intercept, the cut set on unseen hosts, and the scored mail of those hosts that it was set on."""

    weights: np.ndarray
    intercept: float
    cut: float
    held: pd.DataFrame

    def figures(self) -> dict[str, float]:
        """Agreement with the weak labels on mail of unseen hosts, weighted to all documents."""
        w, y, picked = self.held["weight"].to_numpy(), self.held["label"].to_numpy() > 0, self.held["p"].to_numpy() >= self.cut
        div = lambda a, b: float(a / b) if b else 0.0
        return {"held_rows": len(y), "weak_positives": int(y.sum()), "recall": div(w[y & picked].sum(), w[y].sum()), "precision": div(w[y & picked].sum(), w[picked].sum()), "cut": self.cut}


def _sample(read: DataFrame, sample_rows: int, seed: int) -> DataFrame:
    """At most about ``sample_rows`` documents of each weak label, drawn by a hash of the id, with the weight that brings them back to all documents; the labelled rows of the fit."""
    label = F.col("family").isNotNull()
    counts = {r["y"]: r["n"] for r in read.groupBy(label.alias("y")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = {y: min(1.0, sample_rows / counts[y]) if counts.get(y) else 1.0 for y in (True, False)}
    place = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1_000_000)) / F.lit(1_000_000.0)
    kept = F.when(label, F.lit(share[True])).otherwise(F.lit(share[False]))
    drawn = materialize(read.withColumns({"weight": 1 / kept, "label": label.cast("double")}).filter(place < kept), "residue-sample")
    # hosts in the order of a hash are held out until they have a quarter of the positive rows; one host at least stays for the fit
    per = drawn.groupBy("host").agg(F.sum("label").alias("n")).orderBy(F.xxhash64(F.lit(seed), F.col("host"))).collect()
    held, count, total = [], 0.0, sum(r["n"] for r in per)
    for r in per[:-1]:
        if count * 4 >= total:
            break
        held.append(r["host"])
        count += r["n"]
    return drawn.withColumn("held", F.col("host").isin(held) if held else F.lit(False))


def _weights(rows: DataFrame, penalty: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with L2 ``penalty``; where only one label occurs the answer is that label."""
    at = rows.select(_vector("places").alias("features"), "label", "weight")
    labels = {r["label"] for r in at.select("label").distinct().collect()}
    if labels != {0.0, 1.0}:
        return np.zeros(SIZE), 20.0 if labels == {1.0} else -20.0
    model = LogisticRegression(maxIter=60, regParam=penalty, elasticNetParam=0.0, standardization=False, weightCol="weight").fit(at.coalesce(4))
    return model.coefficients.toArray(), float(model.intercept)


def _scored(rows: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    return rows.withColumn("p", probability(F.col("places"), rows.sparkSession.sparkContext.broadcast(weights), intercept))


def validate(sample: DataFrame, penalty: float, without: str | None = None) -> ResidueModel:
    """Fit on the sampled rows of all hosts but those held out, and set the cut on these; ``without`` leaves one family of weak labels out of the fit and of the setting of the cut.

    The cut is where precision and recall balance best; without positive rows among the held-out ones it is 0.5."""
    rows = sample.filter(F.col("family").isNull() | (F.col("family") != F.lit(without))) if without else sample
    weights, intercept = _weights(rows.filter(~F.col("held")), penalty)
    held = _scored(sample.filter("held"), weights, intercept).select("family", "label", "weight", "p").toPandas()
    mine = held[held["family"].isna() | (held["family"] != without)] if without else held
    return ResidueModel(weights, intercept, _best_cut(mine) if (mine["label"] > 0).any() else 0.5, held)


def _best_cut(held: pd.DataFrame) -> float:
    """The score with the largest weighted F1, halfway (in odds) to the next lower one."""
    order = held.sort_values("p", ascending=False)
    w, y, p = order["weight"].to_numpy(), order["label"].to_numpy(), np.clip(order["p"].to_numpy(), 1e-9, 1 - 1e-9)
    hit, picked = np.cumsum(w * y), np.cumsum(w)
    f1 = 2 * hit / (picked + hit[-1])
    f1[:-1][p[:-1] == p[1:]] = -1  # equal scores fall together
    best = int(np.argmax(f1))
    odds = np.log(p / (1 - p))
    middle = (odds[best] + odds[min(best + 1, len(p) - 1)]) / 2
    return float(1 / (1 + np.exp(-middle)))


def train(read: DataFrame, sample_rows: int = 6_000, penalty: float = 1e-4, seed: int = 5) -> ResidueModel:
    """The cut from unseen hosts, the weights from all sampled rows."""
    sample = _sample(read, sample_rows, seed)
    checked = validate(sample, penalty)
    weights, intercept = _weights(sample, penalty)
    return ResidueModel(weights, intercept, checked.cut, checked.held)


def unseen_families(read: DataFrame, sample_rows: int = 6_000, penalty: float = 1e-4, seed: int = 5) -> dict[str, tuple[int, float]]:
    """Per family of weak labels: how many rows of unseen hosts it has, and the share that a classifier finds which never saw the family (nor those hosts)."""
    sample = _sample(read, sample_rows, seed)
    out = {}
    for name in ["field", "repeated", *_FAMILIES, "filler"]:
        fitted = validate(sample, penalty, name)
        p = fitted.held.loc[fitted.held["family"] == name, "p"]
        out[name] = (len(p), float((p >= fitted.cut).mean()) if len(p) else 0.0)
    return out


#: Own parts with fewer function words than this are nobody's sentences.
PROSE = 0.2
#: The share of the cut that a document has to reach where a rule has named it: two pieces of evidence, each weaker alone.
NAMED = 0.1
#: An error page or a notice with its surroundings has no more words than this.
SHORT = 60


def score(documents: DataFrame, sample_rows: int = 6_000, penalty: float = 1e-4, seed: int = 5) -> tuple[DataFrame, ResidueModel]:
    """(``doc_id, p, kept_out, family``) for every document. The classifier decides: ``kept_out`` needs a score at its cut or above, and a ``NAMED`` part of that where a weak rule has named the document.

    A check follows: what no rule has named may only go if it is no prose (few function words), or short and scored without doubt, and has a few words at all. So a weak label alone never keeps a
    document out, and the classifier finds residue that the rules miss. Null and empty texts are never kept out; without weak labels of both kinds (empty or tiny tables) the fit is that of the one label."""
    read = materialize(read_documents(documents), "residue-read")
    fitted = train(read, sample_rows, penalty, seed)
    named = F.col("family").isNotNull() & (F.col("p") >= fitted.cut * NAMED)
    sound = (F.col("n_words") >= 4) & ((F.col("prose") < PROSE) | ((F.col("p") >= 0.9) & (F.col("n_words") <= SHORT)))
    return _scored(read, fitted.weights, fitted.intercept).select("doc_id", "p", (named | ((F.col("p") >= fitted.cut) & sound)).alias("kept_out"), "family", "prose", "n_words"), fitted
