"""Reading raw mail text: what a reader would see, and which part of it is the writer's own.

Pure string helpers for use inside Arrow/pandas functions; Spark partitions the documents. Everything here accepts
``None`` and damaged input (lost header, unclosed part, wrong charset, mixed line ends) and never raises.
"""

from __future__ import annotations

import base64
import binascii
import html
import quopri
import re
import unicodedata

_HEADER_LINE = re.compile(r"[A-Za-z][A-Za-z0-9-]*:(?:[ \t]|$)")
_KNOWN_HEADER = re.compile(
    r"(?i)(from|to|cc|bcc|subject|date|message-id|in-reply-to|references|received|reply-to|sender|return-path|"
    r"mime-version|content-[a-z-]+|x-[a-z-]+|list-[a-z-]+|delivered-to|organization|user-agent|importance|priority|"
    r"precedence|auto-submitted|dkim-signature|authentication-results|thread-[a-z]+):"
)
_BOUNDARY_PARAM = re.compile(r'(?i)boundary\s*=\s*"?([^";\n]+)"?')
_BOUNDARY_LINE = re.compile(r"(?m)^--(?=[^\s-]*[=_0-9])([^\s]{4,70}?)(?:--)?[ \t]*$")
_CHARSET = re.compile(r'(?i)charset\s*=\s*"?([A-Za-z0-9._:-]+)')
_BASE64_BODY = re.compile(r"[A-Za-z0-9+/=\s]+\Z")
_QP_MARK = re.compile(r"=(?:[0-9A-F]{2}|\n)")

#: Characters a reader does not see; they are removed, not treated as word ends.
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯︀-️﻿]")

_HIDDEN_BLOCK = re.compile(r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<!--.*?(?:-->|\Z)")
_BLOCK_TAG = re.compile(
    r"(?i)</?(?:p|div|br|hr|tr|td|th|table|ul|ol|li|h[1-6]|blockquote|body|html|head|title|section|pre|form|button|noscript)\b[^>]*>?"
)
_ANY_TAG = re.compile(r"</?[A-Za-z!][^<>]*>|</?[A-Za-z][^<>]*\Z")
_LOOKS_HTML = re.compile(r"(?i)<(?:html|body|head|p|div|blockquote|table|br|title|h1)\b[^>]*>")
_QUOTE_BLOCK = re.compile(r"(?is)<blockquote\b[^>]*>|</blockquote\s*>")

_QUOTE_MARK = re.compile(r"[ \t\xa0]*(?:(?:[>|»¦]|[A-Z]{1,4}>)[ \t\xa0]*)+")
_QUOTED_LINE = re.compile(r"(?m)^[ \t\xa0]*(?:(?:[>|»¦]|[A-Z]{1,4}>)[ \t\xa0]*)+")
_WORD = re.compile(r"\w+")


def _split_header(text: str) -> tuple[str, str]:
    """Header and body; the header is '' where the text does not begin with one."""
    lines = text.split("\n")
    first = 0
    while first < len(lines) and not lines[first].strip():
        first += 1
    if first == len(lines) or not _KNOWN_HEADER.match(lines[first]):
        return "", text
    i = first
    while i < len(lines) and lines[i].strip():
        if lines[i][0] not in " \t" and not _HEADER_LINE.match(lines[i]):
            break  # the blank line before the body was lost
        i += 1
    return "\n".join(lines[first:i]), "\n".join(lines[i:])


def _to_text(raw: bytes, charset: str | None) -> str:
    """Bytes as text: UTF-8 where it is valid, else the stated charset, else Latin-1."""
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        pass
    for name in (charset, "cp1252"):
        try:
            if name:
                return raw.decode(name)
        except (LookupError, UnicodeDecodeError):
            continue
    return raw.decode("latin-1")


def _mend(text: str) -> str:
    """Undo UTF-8 that was read as an 8-bit charset, where the whole of a damaged word turns back cleanly."""

    def back(m: re.Match) -> str:
        for charset in ("cp1252", "latin-1"):
            try:
                return m.group().encode(charset).decode("utf-8")
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
        return m.group()

    return re.sub("[Â-ô][\u0080-¿Œ-Ÿˆ˜–-™]{1,3}", back, text) if "Ã" in text or "Â" in text or "â" in text else text


def _quoted_printable(body: str) -> bytes:
    return quopri.decodestring(body.encode("utf-8", "replace"))


def _base64(body: str) -> bytes | None:
    packed = re.sub(r"[^A-Za-z0-9+/]", "", body)
    try:
        return base64.b64decode(packed + "=" * (-len(packed) % 4)) if len(packed) % 4 != 1 else base64.b64decode(packed[:-1])
    except (binascii.Error, ValueError):
        return None


def _readable(raw: bytes) -> bool:
    if not raw or b"\x00" in raw:
        return False
    text = _to_text(raw, None)
    odd = sum(1 for c in text if not (c.isprintable() or c in "\n\r\t"))
    return odd * 20 < len(text)


def _decode_body(body: str, encoding: str, charset: str | None) -> str:
    if encoding == "base64" or (not encoding and len(body.strip()) >= 40 and _BASE64_BODY.match(body) and " " not in body.strip()):
        # a plain footer added by a relay may follow the encoded block
        m = re.match(r"\s*(?:[A-Za-z0-9+/]{4,}={0,2}[ \t]*(?:\n|\Z))+", body)
        if m and (raw := _base64(m.group())) is not None and _readable(raw):
            return _to_text(raw, charset) + "\n" + body[m.end() :]
        return body if encoding != "base64" else ""
    if encoding == "quoted-printable" or (not encoding and len(_QP_MARK.findall(body)) >= 2):
        return _to_text(_quoted_printable(body), charset)
    return body


def mail_parts(raw: str | None) -> list[tuple[str, str]]:
    """(kind, text) of each shown part, ``kind`` being 'html' or 'plain', decoded, line ends as ``\\n``; attachments are left out."""
    if not raw:
        return []
    text = raw.replace("\r\n", "\n").replace("\r", "\n")
    header, body = _split_header(text)
    parts: list[tuple[str, str]] = []
    # parts still to read, the next one last; a null header marks text before the first part
    left: list[tuple[str | None, str]] = [(header, body)]
    while left:
        header, body = left.pop()
        if header is None:
            parts.append(("plain", body))
        else:
            left.extend(reversed(_read_part(header, body, parts)))
    return parts


def _read_part(header: str, body: str, parts: list[tuple[str, str]]) -> list[tuple[str | None, str]]:
    """Add a single part to ``parts``, or give back the parts inside a multipart one, nested to any depth."""
    unfolded = re.sub(r"\n[ \t]+", " ", header)
    fields = {}
    for line in unfolded.split("\n"):
        name, sep, value = line.partition(":")
        if sep:
            fields.setdefault(name.strip().lower(), value.strip())
    kind = fields.get("content-type", "").lower()
    bound = None
    if m := _BOUNDARY_PARAM.search(fields.get("content-type", "")):
        bound = m.group(1).strip()
    elif not kind and (m := _BOUNDARY_LINE.search(body)) and re.match(r"\nContent-", body[m.end() :]):
        bound = m.group(1)
    if bound is not None and f"--{bound}" in body:
        first, *pieces = re.split(rf"(?m)^--{re.escape(bound)}(?:--)?[ \t]*$", body)
        if pieces:
            inside: list[tuple[str | None, str]] = [(None, first)] if first.strip() else []
            return inside + [_split_header(x.lstrip("\n")) for x in pieces if x.strip()]
    if "attachment" in fields.get("content-disposition", "").lower() or re.match(r"(application|image|audio|video)/", kind):
        return []
    charset = m.group(1) if (m := _CHARSET.search(fields.get("content-type", ""))) else None
    shown = _mend(_decode_body(body, fields.get("content-transfer-encoding", "").lower(), charset)).replace("\r\n", "\n").replace("\r", "\n")
    is_html = kind.startswith("text/html") or (not kind.startswith("text/plain") and _LOOKS_HTML.search(shown) is not None)
    parts.append(("html" if is_html else "plain", shown))
    return []


def strip_html(text: str) -> str:
    """Markup as a reader sees it: block tags end lines, inline tags vanish, entities are resolved, scripts and styles are hidden."""
    text = _HIDDEN_BLOCK.sub(" ", text)
    text = re.sub(r"\s*\n\s*", " ", text)
    text = _BLOCK_TAG.sub("\n", text)
    return html.unescape(_ANY_TAG.sub("", text))


def clean(text: str) -> str:
    """NFKC form without invisible characters."""
    if text.isascii():
        return text
    return _INVISIBLE.sub("", unicodedata.normalize("NFKC", _INVISIBLE.sub("", text)))


def unquote(text: str) -> str:
    """Without the quote marks at the beginning of lines."""
    return re.sub(_QUOTED_LINE, "", text)


def words(text: str | None) -> list[str]:
    """Lower-case words; punctuation, white space and invisible characters are set aside."""
    return _WORD.findall(clean(text).replace("_", " ").casefold()) if text else []


def visible_words(raw: str | None) -> list[list[str]]:
    """The words of each shown part of a mail, quoted text included, quote marks excluded."""
    found = []
    for kind, text in mail_parts(raw):
        shown = unquote(strip_html(text) if kind == "html" else text)
        if kind == "plain" and _LOOKS_HTML.search(shown):
            shown = strip_html(shown)
        if w := words(shown):
            found.append(w)
    return found


# ---------------------------------------------------------------------------------------------------------------------
# The writer's own part
# ---------------------------------------------------------------------------------------------------------------------

#: Lines that introduce quoted or forwarded mail, in the languages of the archive.
_ATTRIBUTION = re.compile(
    r"(?i)^\s*(?:(?:on|am|le|el)\b[^\n]{0,160}?\b(?:wrote|schrieb|a écrit|escribió)\b[^\n]{0,80}:?\s*$|"
    r"-{2,}\s*(?:original message|forwarded message|ursprüngliche nachricht|weitergeleitete nachricht|message d'origine|message transféré|"
    r"mensaje original|mensaje reenviado)\b.*|begin forwarded message:?\s*$)"
)
_STARTS = frozenset(["On", "on", "Am", "am", "Le", "le", "El", "el", "--", "Be", "be"])
_ATTRIBUTION_START = re.compile(r"(?i)^\s*(?:on|am|le|el)\b.{0,60}(?:\d|n\.d\.|,)")
_ATTRIBUTION_END = re.compile(r"(?i)(?:\bwrote|\ba écrit|\bescribió)\s*:\s*$|\bschrieb\b[^:]{0,80}:\s*$")
_FORWARD_RULE = re.compile(r"^\s*-{3,}.*-{3,}\s*$|^\s*-{5,}\s*$|^\s*_{8,}\s*$")


def own_lines(kind: str, text: str) -> list[str]:
    """Lines of one part that its writer wrote: quoted lines, quote blocks and the lines that introduce them are left out.

    A quoted block may stand above or below the writer's words. A forwarded message without quote marks reaches to the end of the part."""
    if kind == "html":
        depth, kept, at = 0, [], 0
        for m in _QUOTE_BLOCK.finditer(text):
            if depth == 0:
                kept.append(text[at : m.start()])
            depth = max(0, depth - 1) if m.group().startswith("</") else depth + 1
            at = m.end()
        if depth == 0:
            kept.append(text[at:])
        text = strip_html("\n".join(kept))
    lines = clean(text).split("\n")
    own: list[str] = []
    i = 0
    while i < len(lines):
        line = lines[i]
        if m := _QUOTE_MARK.match(line):
            if m.end():
                own.append("")
                i += 1
                continue
        if line.lstrip()[:2] in _STARTS and _ATTRIBUTION_START.match(line):
            for span in (1, 2, 3):
                joined = " ".join(x.strip() for x in lines[i : i + span])
                if _ATTRIBUTION_END.search(joined) and len(joined) < 200:
                    break
            else:
                span = 0
            if span:
                rest = [x for x in lines[i + span :] if x.strip()]
                i += span
                if rest and not _QUOTE_MARK.match(rest[0]) and kind != "html":
                    # the quote marks are gone: what follows is the quoted mail
                    break
                continue
        if line.lstrip()[:2] in _STARTS and _ATTRIBUTION.match(line):
            break
        own.append(line)
        i += 1
    return own
