"""Text helpers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token price = ceil(chars / 4) + 4 per block, + 4 per message.
CHARS_PER_TOKEN, BLOCK_OVERHEAD, ROLE_OVERHEAD = 4, 4, 4

# Control sequences stripped from titles, in this order.
OSC = r"(?:\u001B\]|\u009D)(?:(?!\u0007|\u001B\\)[\s\S])*(?:\u0007|\u001B\\|$)"
CSI = r"(?:\u001B\[|\u009B)[0-?]*[ -/]*[@-~]"
ESC = r"\u001B[@-_]"
CONTROL = r"[\u0000-\u0008\u000B\u000C\u000E-\u001F\u007F-\u009F]"
# Invisible and directional characters.
DIRECTIONAL = (
    r"[\u200B"  # zero-width space
    r"\u200E"  # left-to-right mark
    r"\u200F"  # right-to-left mark
    r"\u202A-\u202E"  # embeddings and overrides
    r"\u2060-\u2064"  # word joiner, invisible operators
    r"\u2066-\u206F"  # isolates, deprecated format characters
    r"\uFEFF]"  # byte order mark
)

# Named entities decoded in page text.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))
PAGE_TEXT_CAP = 200_000
PRUNE_THRESHOLD, PRUNE_HEAD, PRUNE_TAIL = 8192, 4096, 1024
PRUNE_MARKER = "\n[... middle removed ...]\n"


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def preview(text: Column, limit: int) -> Column:
    """Collapsed text clipped to ``limit - 1`` characters plus an ellipsis."""
    clipped = F.char_length(text) > 2 * limit
    short = collapse(F.substring(text, 1, 2 * limit))
    return (F.when(F.char_length(short) > limit - 1, F.concat(F.rtrim(F.substring(short, 1, limit - 1)), F.lit("…")))
            .when(clipped, F.concat(short, F.lit("…"))).otherwise(short))


def clean_title(text: Column) -> Column:
    out = text
    for pattern in (OSC, CSI, ESC, CONTROL, DIRECTIONAL):
        out = F.regexp_replace(out, pattern, "")
    return collapse(out)


def _continues(raw: Column, at: Column) -> Column:
    """True when the byte at 1-based ``at`` continues a UTF-8 character."""
    b = F.hex(F.substring(raw, at, F.lit(1)))
    return b.between("80", "BF")


def utf8_truncate(text: Column, max_bytes: int) -> Column:
    """Longest whole-character prefix within a byte budget, by looking at four bytes only."""
    raw = text.cast("binary")
    cut = F.lit(max_bytes)
    size = F.coalesce(*[F.when(~_continues(raw, cut + 1 - d), cut - d) for d in range(4)], F.lit(0))
    head = F.decode(F.substring(raw, F.lit(1), size), "UTF-8")
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(head)


def utf8_tail(text: Column, max_bytes: int) -> Column:
    """Longest whole-character suffix within a byte budget."""
    raw = text.cast("binary")
    start = F.octet_length(text) - max_bytes + 1
    at = F.coalesce(*[F.when(~_continues(raw, start + d), start + d) for d in range(4)])
    tail = F.decode(F.substring(raw, at, F.octet_length(text) - at + 1), "UTF-8")
    return F.when(F.octet_length(text) <= max_bytes, text).otherwise(tail)


def fallback_title(text: Column, words: int, max_bytes: int) -> Column:
    kept = F.slice(F.filter(F.split(clean_title(text), " "), lambda w: w != ""), 1, words)
    return F.rtrim(utf8_truncate(F.array_join(kept, " "), max_bytes))


def prune_middle(text: Column, threshold: int = PRUNE_THRESHOLD, head: int = PRUNE_HEAD, tail: int = PRUNE_TAIL) -> Column:
    n = F.char_length(text)
    return F.when(n > threshold, F.concat(F.substring(text, 1, head), F.lit(PRUNE_MARKER),
                                          F.substring(text, n - tail + 1, F.lit(tail)))).otherwise(text)


def block_tokens(chars: Column) -> Column:
    return F.ceil(chars / F.lit(CHARS_PER_TOKEN)) + BLOCK_OVERHEAD


def message_tokens(text: Column, system: Column | None = None) -> Column:
    """Price of a one-block message; a system message carries the role overhead only, 0 when empty."""
    n = F.char_length(text)
    price = block_tokens(n) + ROLE_OVERHEAD
    if system is None:
        return price
    return F.when(system, F.when(n == 0, 0).otherwise(F.ceil(n / F.lit(CHARS_PER_TOKEN)) + ROLE_OVERHEAD)).otherwise(price)


def html_title(html: Column) -> Column:
    return decode_entities(collapse(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)))


def decode_entities(text: Column) -> Column:
    out = text
    for name, ch in ENTITIES:
        out = F.replace(out, F.lit(name), F.lit(ch))
    return out


def html_to_text(html: Column, cap: int = PAGE_TEXT_CAP) -> Column:
    out = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in ("script", "style", "head", "noscript"):
        out = F.regexp_replace(out, rf"(?is)<{tag}[ >].*?</{tag}>", " ")
    out = decode_entities(F.regexp_replace(out, r"<[^>]*>", " "))
    return F.substring(collapse(out), 1, cap)


def terms(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")
