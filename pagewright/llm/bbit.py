"""b-bit MinHash near-duplicates.

Each distinct set of word 5-grams gets MINWISE minima. BANDS bands of ROWS of them, hashed whole, say where sets meet: two
sets of similarity s share a band with probability s ** ROWS. Of the minima themselves only BITS low bits are kept, packed
to 64 bytes a set. Two unequal minima agree in these by chance once in 2 ** BITS times, so the share of places in which two
signatures agree, counted bit-parallel, is corrected for such collisions to tell the similarity.

Bands that few sets share are compared pair by pair on signatures; sets whose band is shared by very many (templates, mass
copies) are tied to a pivot or split by further minima, as in ``chosen_path``. The pairs found span candidate groups, within
which links are confirmed on the full sets, in blocks of bounded size. A link of just the threshold meets in no band with a
chance of 4.6e-5 (7.2e-5 where each of its bands is a large one), and signatures lose it with 0.2e-5.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import NONSPACE, mix
from .chosen_path import COORDS, MINWISE, Scheme, _binomial, parted, similar_classes

THRESHOLD = 0.85
BANDS, ROWS, BITS = 32, 7, 2
#: Estimated similarity from which a pair is a candidate, and the pivot's inner and outer similarity.
CANDIDATE = 0.71
INNER, OUTER = 0.76, 0.47
_ONES = np.uint64(0x5555555555555555)


def low_bits(values: np.ndarray) -> np.ndarray:
    """The low BITS of each minimum, scrambled first, packed into 64-bit words."""
    v = values * np.uint32(0x9E3779B1)
    v ^= v >> np.uint32(16)
    v = (v & np.uint32(3)).astype(np.uint8).reshape(len(v), -1, 4)
    return np.ascontiguousarray(v[..., 0] | v[..., 1] << 2 | v[..., 2] << 4 | v[..., 3] << 6).view(np.uint64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity told by broadcast rows of packed bits: the share of equal places less what chance makes equal."""
    apart = a ^ b
    apart = (apart | apart >> np.uint64(1)) & _ONES
    agree = 1 - np.bitwise_count(apart).sum(axis=-1, dtype=np.int64) / MINWISE
    chance = 1 / 2**BITS
    return (agree - chance) / (1 - chance)


def bands(values: np.ndarray) -> np.ndarray:
    """A hash of each band of minima; bands differ by their number."""
    parts = values[:, : BANDS * ROWS].reshape(len(values), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2])
    for k in range(ROWS):
        h = mix(h * np.uint64(3) + parts[..., k])
    return h


def bands_miss(similarity: float, large: bool) -> float:
    """How likely a pair of the similarity meets in no band; ``large``: where all bands are large and split to the last."""
    share = np.arange(MINWISE + 1) / MINWISE
    kept = 1 - parted(share) if large else 1.0
    return float((_binomial(MINWISE, similarity) * (1 - share**ROWS * kept) ** BANDS).sum())


def signature_miss(similarity: float) -> float:
    """How likely signatures lose a pair of the similarity: by its own estimate, or at a pivot that lies in line with both."""
    chance = 1 / 2**BITS
    differ = _binomial(MINWISE, (1 - similarity) * (1 - chance))
    apart = np.arange(MINWISE + 1) / MINWISE / (1 - chance)
    return float(differ[1 - apart < CANDIDATE].sum() + differ[apart > INNER - OUTER].sum())


def scheme() -> Scheme:
    return Scheme(NONSPACE, THRESHOLD, low_bits, estimate, CANDIDATE, INNER, OUTER, bands)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Links: 100 * shared >= 85 * united 5-grams of words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased; a text of fewer words
    is one gram. ``component_id``: the smallest doc_id that links reach, null ids left out. ``kept``: doc_id is that id, so
    repeated rows are kept or not alike, and a row without id only where its whole component has none. Texts without
    words, null ones too, have no grams and no links. An empty table gives no rows; other columns play no part.
    """
    found = similar_classes(docs, THRESHOLD, count_links=False, scheme=scheme())
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("class_id").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("class_id")).alias("kept"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM w WHERE len(w) > 0)),
s AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(gram, '|' ORDER BY gram)) AS sig FROM g GROUP BY doc_id),
c AS MATERIALIZED (SELECT sig, min(doc_id) AS id, any_value(n) AS n FROM s GROUP BY sig),
cg AS MATERIALIZED (SELECT doc_id, gram FROM g WHERE doc_id IN (SELECT id FROM c)),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM cg x JOIN cg y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN c ca ON ca.id = p.a JOIN c cb ON cb.id = p.b WHERE 100 * common >= 85 * (ca.n + cb.n - common)),
reach(a, b) AS (SELECT id, id FROM c UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
root AS (SELECT a AS id, min(b) AS root FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, coalesce(root.root, w.doc_id) AS component_id, coalesce(root.root, w.doc_id) = w.doc_id AS kept
FROM w LEFT JOIN s ON s.doc_id = w.doc_id LEFT JOIN c ON c.sig = s.sig LEFT JOIN root ON root.id = c.id
"""
