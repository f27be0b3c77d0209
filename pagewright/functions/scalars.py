"""Scalar functions of the retrieval engine as Column expressions; no Python runs on executors here."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points that count as one token each (fixed values).
CJK_RANGES = ((0x2E80, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFB4F), (0xFF00, 0xFFEF), (0x20000, 0x2FA1F))
CJK_CLASS = "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in CJK_RANGES)
#: White space as Unicode has it, for engines whose \s is ASCII.
SPACE = r"[\s\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: The same characters one by one.
SPACES = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Namespace of point ids: the URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
PAGE_MARKER = r"(?i)<!--\s*page:\s*(\d+)\s*-->"


def cjk_count(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[^{CJK_CLASS}]+", ""))


def token_count(text: Column) -> Column:
    """One token for each CJK character and one for each four other characters begun; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    cjk = cjk_count(text)
    return (cjk + F.ceil((F.length(text) - cjk) / 4)).cast("int")


def text_checksum(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def stable_chunk_id(document_id: Column, index: Column) -> Column:
    return F.format_string("%s:%06d", document_id, index)


def point_id(chunk_id: Column) -> Column:
    """uuid5 of the chunk id in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), chunk_id.cast("binary")))
    variant = F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(63).bitwiseOR(128)
    return F.lower(F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), F.lpad(F.hex(variant), 2, "0"), F.substring(h, 19, 2), F.lit("-"), F.substring(h, 21, 12)))


def l2_normalise(vector: Column) -> Column:
    """A zero vector stays as it is."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, vector.cast("array<double>")).otherwise(F.transform(vector, lambda x: x.cast("double") / norm))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def normalise_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def decode_utf8(content: Column) -> Column:
    """Malformed bytes become replacement characters; a byte order mark stays."""
    return F.make_valid_utf8(content.cast("string"))


def failure_reason(message: Column) -> Column:
    return F.substring(message, 1, 1000)


def sentence_units(text: Column) -> Column:
    """Array of sentences: paragraphs between blank lines, each split after an ideographic stop or after a run of .!?
    that white space or the end follows. Marks stay with what they end; blank units are dropped."""
    # what is dear is tried last and only beside a mark; ends are stripped without a pattern that enters every run of white space
    cut = rf"(?<=[。．.!?])(?:(?<=[。．])|(?={SPACE}|\z)|(?=[。．])(?<=(?:^|[。．])[.!?]{{1,64}}))"
    paragraphs = F.transform(F.split(F.coalesce(text, F.lit("")), rf"\n{SPACE}*\n"), lambda x: F.btrim(x, F.lit(SPACES)))
    units = F.flatten(F.transform(paragraphs, lambda p: F.split(p, cut)))
    return F.filter(units, lambda u: u.rlike(f"[^{SPACE[1:]}"))
