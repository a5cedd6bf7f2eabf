"""The text a mail's author wrote: MIME decoded, without earlier mails, signature and disclaimer.

Plain functions on one text, for use inside Arrow batches.
"""

from __future__ import annotations

import binascii
import html
import re
from dataclasses import dataclass

_HEADER_END = re.compile(r"\r?\n[ \t]*\r?\n|\r[ \t]*\r(?!\n)")
_FIELD = re.compile(r"^([A-Za-z][A-Za-z0-9-]*)[ \t]*:[ \t]*(.*(?:\r?\n[ \t]+.*)*)", re.M)
_BOUNDARY = re.compile(r"boundary[ \t]*=[ \t]*(?:\"([^\"]+)\"|([^\s;]+))", re.I)
_CHARSET = re.compile(r"charset[ \t]*=[ \t]*\"?([\w.:-]+)", re.I)
_BASE64 = re.compile(rb"[A-Za-z0-9+/\s]*")  # what follows the padding is no content
_MOJIBAKE = re.compile("[ÂÃ][\u0080-¿‘-›€Œ-Ÿ]|â[\u0080€]")
_DEPTH = 8  # of nested parts

_DROP = re.compile(r"<(head|style|script|title)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_NOSCRIPT = re.compile(r"<noscript\b[^>]*>(.*?)(?:</noscript\s*>|\Z)", re.I | re.S)
_QUOTE_TAG = re.compile(r"<blockquote\b.*?(?:</blockquote\s*>|\Z)", re.I | re.S)
_BREAK = re.compile(r"<(?:br|hr)\b[^>]*>", re.I)
_BLOCK = re.compile(r"</?(?:p|div|table|tr|ul|ol|li|h[1-6]|body|html|pre)\b[^>]*>", re.I)
_CODE_TAG = re.compile(r"<(pre|code)\b[^>]*>(.*?)(?:</\1\s*>|\Z)", re.I | re.S)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")

_ATTRIBUTION = re.compile(
    r"^[ \t]*(?:(?:On|Em|El|Am|Le|No dia)\b.{0,200}|.{0,120})\b(?:wrote|escreveu|escribió|schrieb)\b.{0,120}:[ \t]*$", re.I
)
_CARRIED = re.compile(
    r"^[ \t]*-{2,}[ \t]*(?:Original Message|Mensagem original|Mensaje original|Ursprüngliche Nachricht|Forwarded message|Mensagem encaminhada|Mensaje reenviado|Weitergeleitete Nachricht)\b.*$", re.I
)
_RULE = re.compile(r"^[ \t]*(?:--[ \t]?|_{3,}|\*{3,}|={5,}|-{5,})[ \t]*$")
_CLOSING = re.compile(
    r"^(?:att\.?|atenciosamente|abraços?|obrigad[oa]|grat[oa]|thanks|thank you|cheers|best|best regards|kind regards|regards|sincerely|gracias|saludos|un abrazo|atentamente|danke|viele grüße|grüße|beste grüße|mit freundlichen grüßen|liebe grüße|vg|lg)[,.!]?$",
    re.I,
)


@dataclass
class Own:
    """What a mail says itself: paragraphs of prose, code lines apart, and the notice for browsers without scripts."""

    text: str
    notice: str


def _decoded(body: str, encoding: str, charset: str) -> str:
    if encoding in ("quoted-printable", "base64"):
        raw = body.encode("utf-8", "surrogateescape")
        try:
            raw = binascii.a2b_qp(raw) if encoding[0] == "q" else binascii.a2b_base64(re.sub(rb"\s", b"", _BASE64.match(raw)[0]) + b"===")
        except (binascii.Error, ValueError):
            return body
        for name in (charset or "utf-8", "utf-8", "cp1252"):
            try:
                return raw.decode(name)
            except (LookupError, UnicodeDecodeError):
                continue
        return raw.decode("latin-1")
    return body


def _mended(text: str) -> str:
    """Text that was read as a single-byte code page although it was UTF-8, put right where that is possible."""
    if _MOJIBAKE.search(text):
        for page in ("cp1252", "latin-1"):
            try:
                return text.encode(page).decode("utf-8")
            except UnicodeError:
                continue
    return text


def _split(text: str) -> tuple[dict[str, str], str]:
    """Header fields (lower-case names) and the body of a mail or a part."""
    end = _HEADER_END.search(text)
    head, body = (text[: end.start()], text[end.end() :]) if end else (text, "")
    fields = {m[1].lower(): re.sub(r"\r?\n[ \t]+", " ", m[2]).strip() for m in reversed(list(_FIELD.finditer(head)))}
    if not fields:
        return {}, text
    return fields, body


_LINE_REST = re.compile(r"(?:--)?[ \t]*(?=\r?\n|$)")


def _between(body: str, mark: str) -> list[str]:
    """The pieces of a body between the lines that consist of the mark, two more dashes and blanks allowed behind it."""
    pieces, start, at = [], 0, body.find(mark)
    while at >= 0:
        rest = _LINE_REST.match(body, at + len(mark))
        if rest and (at == 0 or body[at - 1] == "\n"):
            end = at if at == 0 else at - 1
            end -= end > start and body[end - 1] == "\r" and at > 0
            pieces.append(body[start:end])
            start = rest.end()
            at = body.find(mark, start)
        else:
            at = body.find(mark, at + 1)
    return [*pieces, body[start:]]


def _texts(fields: dict[str, str], body: str, depth: int = 0) -> list[tuple[str, str]]:
    """(kind, text) of the parts to read, kind being plain or html; attachments and carried mails left out."""
    kind = fields.get("content-type", "text/plain").lower()
    if kind.startswith("multipart/") and depth < _DEPTH:
        mark = _BOUNDARY.search(fields["content-type"])
        if mark:
            parts = [_texts(*_split(p.lstrip("\r\n")), depth + 1) for p in _between(body, "--" + (mark[1] or mark[2]))[1:] if p.strip()]
            parts = [p for p in parts if p]
            if kind.startswith("multipart/alternative"):
                plain = [p for p in parts if p[0][0] == "plain" and p[0][1].strip()]
                return plain[0] if plain else parts[-1] if parts else []
            return [t for p in parts for t in p]
    if "attachment" in fields.get("content-disposition", "").lower() or not (kind.startswith("text/") or kind.startswith("multipart/")):
        return []
    charset = _CHARSET.search(kind)
    text = _decoded(body, fields.get("content-transfer-encoding", "").strip().lower(), charset[1] if charset else "")
    if kind.startswith("text/html"):
        return [("html", text)]
    return [("plain", text)] if kind.startswith(("text/plain", "multipart/")) else []


def _from_html(text: str) -> tuple[str, str]:
    text = _COMMENT.sub(" ", _DROP.sub(" ", text))
    notice = "\n".join(_NOSCRIPT.findall(text))
    text = _QUOTE_TAG.sub("\n", _NOSCRIPT.sub("\n", text))
    text = _CODE_TAG.sub(lambda m: "\n" + "\n".join("    " + x for x in m[2].split("\n")) + "\n" if m[1].lower() == "pre" else f"`{m[2]}`", text)
    clean = lambda t: html.unescape(_TAG.sub("", _BLOCK.sub("\n\n", _BREAK.sub("\n", t))))
    return clean(text), clean(notice)


def own_text(text: str | None) -> Own:
    """The author's own words in a stored mail; empty for null, empty and blank texts.

    Headers, attachments, quoted lines, carried mails, and what follows a
    signature or disclaimer rule or a closing formula are left out. A text
    without header fields is taken as the body itself.
    """
    if not text or not text.strip():
        return Own("", "")
    fields, body = _split(text.lstrip("﻿"))
    plain, notices = [], []
    for kind, part in _texts(fields, body):
        if kind == "html":
            part, notice = _from_html(part)
            notices.append(notice)
        plain.append(part)
    lines = _mended("\n\n".join(plain)).replace("\r\n", "\n").replace("\r", "\n").split("\n")
    kept: list[str] = []
    skipping = False  # after a rule or a closing formula, up to a quotation that own text may follow
    for line in lines:
        bare = line.strip()
        if line.startswith(">"):
            skipping = False
            continue
        if _CARRIED.match(line):
            break
        if _ATTRIBUTION.match(line):
            skipping = False
            continue
        if _RULE.match(line) or _CLOSING.match(bare):
            skipping = True
        if not skipping:
            kept.append(line)
    return Own("\n".join(kept).strip("\n"), _mended("\n".join(notices)).strip())
