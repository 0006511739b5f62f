"""Text parts of whole mail messages, and their words."""

from __future__ import annotations

import binascii
import html
import mimetypes
import re

from sonarloom.llm.forms import consistent

_TYPE = re.compile(r"(?im)^content-type[ \t]*:[ \t]*([^;\s]+)([^\n]*)")
_ENCODING = re.compile(r"(?im)^content-transfer-encoding[ \t]*:[ \t]*([\w-]+)")
_NAME = re.compile(r"(?im)\b(?:file)?name\*?\d*\*?[ \t]*=[ \t]*\"?([^\";\n]+)")
_BOUNDARY = re.compile(r"(?i)\bboundary[ \t]*=[ \t]*(?:\"([^\"]*)\"|([^\s;\"]+))")
_CHARSET = re.compile(r"(?i)\bcharset[ \t]*=[ \t]*\"?([\w.:-]+)")
_FOLD = re.compile(r"\n[ \t]+")
_HEADER = re.compile(r"[!-9;-~]+[ \t]*:")
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]+")
# Tags that end a line of text, and endings of text files.
_BREAKING = "address article aside blockquote body br caption dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main nav ol option p pre section table tbody td tfoot th thead title tr ul".split()
_TEXT_FILES = ".txt .text .md .rst .csv .tsv .log .html .htm .xml .json .yaml .yml .ini .cfg .conf .toml .srt .vtt .ics .vcf .tex .sql .diff .patch .eml".split()
_TYPES = mimetypes.MimeTypes(())
_HIDDEN = re.compile(r"(?is)<!--.*?-->|<(style|script)\b.*?</\1\s*>")
_BREAK = re.compile(rf"(?i)</?(?:{'|'.join(_BREAKING)})\b[^>]*>")
_TAG = re.compile(r"<[a-zA-Z/!?][^>]*>")
_WORD = re.compile(r"[^\W_]+")


def _split(block: str) -> tuple[str, str]:
    """(headers, body) of a message or part."""
    if block.startswith("\n"):
        return "", block[1:]
    if not _HEADER.match(block):
        return "", block
    head, _, body = block.partition("\n\n")
    return _FOLD.sub(" ", head), body


def _decoded(body: str, encoding: str, charset: str) -> str:
    if encoding == "base64":
        kept = _NOT_BASE64.sub("", body)
        raw = binascii.a2b_base64(kept[: len(kept) - (len(kept) % 4 == 1)] + "=" * (-len(kept) % 4 % 3))
    elif encoding == "quoted-printable":
        raw = binascii.a2b_qp(body.encode("utf-8", "surrogatepass"))
        if not body.isascii():
            charset = "utf-8"
    else:
        return body
    try:
        return raw.decode(charset, "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def _visible(markup: str) -> str:
    return html.unescape(_TAG.sub("", _BREAK.sub("\n", _HIDDEN.sub(" ", markup))))


def _is_text_file(name: str) -> bool:
    """By its ending: those above, and all that Python's own table of types calls text."""
    return "." + name.rpartition(".")[2] in _TEXT_FILES or (_TYPES.guess_type(name)[0] or "").startswith("text/")


def text_parts(message: str) -> list[str]:
    """Every text part, with transfer encoding undone and HTML tags and entities resolved.

    Named text attachments are text parts; other attachments are not. A part whose boundary or
    encoding is cut off is read as far as it goes.
    """
    out: list[str] = []
    todo = [message.replace("\r\n", "\n")]
    while todo:
        head, body = _split(todo.pop())
        found = _TYPE.search(head) if head else None
        kind, rest = (found[1].lower(), found[2]) if found else ("text/plain", "")
        if kind.startswith("multipart/"):
            b = _BOUNDARY.search(rest)
            mark = b and (b[1] or b[2])
            if not mark:
                out.append(body)
                continue
            parts: list[str] = []
            for piece in ("\n" + body).split("\n--" + mark)[1:]:
                line, _, rest = piece.partition("\n")
                line = line.rstrip(" \t")
                if line == "--":
                    break
                if not line:
                    parts.append(rest)
                elif parts:  # a line of the body that only begins like a delimiter
                    parts[-1] += "\n--" + mark + piece
            todo += parts
            continue
        encoding = (e[1].lower() if (e := _ENCODING.search(head)) else "") if head else ""
        if kind.startswith("message/"):
            todo.append(_decoded(body, encoding, "utf-8"))
            continue
        if not kind.startswith("text/"):
            name = _NAME.search(head)
            if not name or not _is_text_file(name[1].strip().lower()):
                continue
        text = _decoded(body, encoding, c[1] if (c := _CHARSET.search(rest)) else "utf-8")
        out.append(_visible(text) if kind in ("text/html", "application/xhtml+xml") else text)
    return out


def words(text: str) -> list[str]:
    """Longest runs of letters or digits, in consistent form and lower case."""
    return _WORD.findall(consistent(text).lower())
