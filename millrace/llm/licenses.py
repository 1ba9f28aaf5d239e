"""License scans (operator 7): sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

1. Passages of whole texts are found: blocks of lines (comment marks removed)
   that speak of a licence, the single lines and up to three neighbouring
   sentences in them that do, and licence files as a whole.
2. Terms are weighted by their inverse frequency among all passages of all files.
   Only the templates' terms are counted; every other term is as rare as can be.
3. Each passage is compared with the templates through their shared terms; a
   file's licence is that of its best passage.
4. A licence file's licence holds for its directory; every other file inherits it
   from its nearest ancestor directory that has one, by an equi-join of ancestor
   paths. A directory of any number of files is one row there, and hot ones do
   not gather their files in one task (``lookup``).

Templates and their terms are a fixed table, so the counts that come to the
driver and go to every task are bounded by it.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import lookup, staged
from millrace.llm.license_templates import TEMPLATES

_KEYWORDS = (
    r"(?i)licen[sc]e|copyright|rights reserved|public domain|permission is hereby|permission to use|redistribution"
    r"|all copyright|free software|proprietary"
)
_SPEAKS = re.compile(_KEYWORDS)
_TERM = re.compile(r"spdx=[a-z0-9.+-]+|[a-z]+|[0-9]+(?:\.[0-9]+)*")
_SPDX = re.compile(r"spdx-licen[sc]e-identifier\s*:\s*\(?\s*([a-z0-9.+-]+)")
_LATER = re.compile(r"-(?:only|or-later)$|\+$")
_MARKS = re.compile(r"^[\s/*#;!%<>|\"'-]+|[\s*/<>|\"'-]+$")
_SENTENCE = re.compile(r"(?<=[.!?;:])\s+")
#: Sentences of a passage at most; templates of more are blocks or files.
_SPAN = 3


def terms_of(passage: str) -> Counter:
    """Lower-cased terms with their counts: words, numbers with their dots, and an identifier tag as one term."""
    low = passage.lower().replace("licence", "license")
    low = _SPDX.sub(lambda m: " spdx=" + _LATER.sub("", m[1].rstrip(".")) + " ", low)
    return Counter(_TERM.findall(low))


def passages(text: str | None, whole: bool) -> list[str]:
    """The passages of a text in order, once each; ``whole``: the text is a licence file."""
    if not text or not _SPEAKS.search(text):
        return []
    out: dict[str, None] = {}
    block: list[str] = []
    for line in [*text.splitlines(), ""]:
        bare = _MARKS.sub("", line)
        if bare:
            block.append(bare)
            continue
        joined = " ".join(block)
        if block and _SPEAKS.search(joined):
            out.update((x, None) for x in block if _SPEAKS.search(x))
            sentences = _SENTENCE.split(joined)
            for k, s in enumerate(sentences):
                if _SPEAKS.search(s):
                    for a in range(max(0, k - _SPAN + 1), k + 1):
                        out.update((" ".join(sentences[a:b]), None) for b in range(k + 1, min(len(sentences), a + _SPAN) + 1))
            out[joined] = None
        block = []
    if whole:
        out[text] = None
    return list(out)


class Matcher:
    """Weights of the templates, from the counts of their terms among ``n`` passages."""

    def __init__(self, n: int, frequency: dict[str, int]):
        own = [terms_of(t) for _, t in TEMPLATES]
        self.rare = math.log(1 + n + len(own))
        self.idf = {t: math.log(1 + (n + len(own)) / (1 + frequency.get(t, 0))) for c in own for t in c}
        self.index: dict[str, list[tuple[int, float]]] = defaultdict(list)
        for k, c in enumerate(own):
            norm = math.sqrt(sum((f * self.idf[t]) ** 2 for t, f in c.items()))
            for t, f in c.items():
                self.index[t].append((k, f * self.idf[t] / norm))

    def best(self, passage: str) -> tuple[float, int]:
        """(cosine, template) of the nearest template; the first of equally near ones."""
        count = terms_of(passage)
        weight = {t: f * self.idf.get(t, self.rare) for t, f in count.items()}
        norm = math.sqrt(sum(w * w for w in weight.values()))
        dots: dict[int, float] = defaultdict(float)
        for t, w in weight.items():
            for k, share in self.index.get(t, ()):
                dots[k] += w * share
        if not dots:
            return 0.0, 0
        cosine, k = max((round(d / norm, 9), -k) for k, d in dots.items())
        return cosine, -k


def match_templates(files: DataFrame, least: float, file_names: str) -> DataFrame:
    """(path, license, similarity): the best template of each file (path, text) with a cosine of ``least`` or more.

    Ties go to the earlier passage, then to the template that is listed first; of
    repeated paths to the most similar text, then to the licence's name.
    """
    spoken = files.where(F.col("text").rlike(_KEYWORDS)).select("path", "text", F.element_at(F.split("path", "/"), -1).rlike(file_names).alias("whole"))
    found = staged(spoken, "license-texts")
    known = sorted({t for _, text in TEMPLATES for t in terms_of(text)})

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, count, n = set(known), Counter(), 0
        for batch in batches:
            for text, whole in zip(batch.column(1), batch.column(2)):
                for p in passages(text.as_py(), whole.as_py()):
                    n += 1
                    count.update(wanted.intersection(terms_of(p)))
        yield pa.RecordBatch.from_arrays([pa.array(["", *count]), pa.array([n, *count.values()], pa.int64())], names=["term", "n"])

    sums = found.mapInArrow(counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    frequency = {r["term"]: r["n"] for r in sums.collect()}  # the templates' terms at most
    matcher = Matcher(frequency.pop("", 0), frequency)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, names, cosines = [], [], []
            for path, text, whole in zip(*batch.columns):
                tried = [matcher.best(p) for p in passages(text.as_py(), whole.as_py())]
                cosine, k = max(tried, key=lambda x: x[0], default=(0.0, 0))
                if cosine >= least:
                    paths.append(path.as_py())
                    names.append(TEMPLATES[k][0])
                    cosines.append(cosine)
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), pa.array(names, pa.string()), pa.array(cosines, pa.float64())], names=["path", "license", "similarity"]
            )

    matched = found.mapInArrow(scored, "path string, license string, similarity double")
    best = F.max(F.struct("similarity", "license")).alias("b")
    return matched.groupBy("path").agg(best).select("path", "b.license", F.round("b.similarity", 6).alias("similarity"))


def scan_licenses(
    files: DataFrame,
    path_col: str = "path",
    text_col: str = "text",
    least: float = 0.6,
    file_names: str = r"(?i)^(licen[sc]e|copying|unlicense|notice)([-._].*)?$",
) -> DataFrame:
    """(path, license, similarity, inherited, inherited_from): a row for each path.

    A path's own statement wins; else it takes the licence of the nearest ancestor
    directory with a licence file (``file_names`` on the last part of the path; of
    several in one directory the least path counts). A null or empty text has no
    statement; a null path is kept, without inheritance; repeated paths are one
    file; an empty table gives an empty one. Texts are read whole, however long.
    Other columns are ignored, whatever their names.
    """
    plain = files.select(F.col(f"`{path_col}`").cast("string").alias("path"), F.col(f"`{text_col}`").alias("text"))
    own = staged(match_templates(plain.where("path IS NOT NULL"), least, file_names), "license-own")
    joined = staged(plain.select("path").distinct().join(own, "path", "left"), "license-files")
    parts = F.split("path", "/")
    folder = F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/")
    sources = own.where(F.element_at(parts, -1).rlike(file_names)).select(folder.alias("folder"), "path", "license")
    sources = sources.groupBy("folder").agg(F.min_by("license", "path").alias("inherited"), F.min("path").alias("inherited_from"))
    bare = joined.where("license IS NULL AND path IS NOT NULL").withColumn("own_folder", folder)
    # distinct folders first: a folder of any number of files is one row
    folders = bare.groupBy("own_folder").agg(F.count(F.lit(1)).alias("n"))
    steps = F.split("own_folder", "/")
    above = F.transform(
        F.sequence(F.lit(0), F.size(steps)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(steps, F.lit(1), k), "/").alias("folder"))
    )
    climbed = folders.select("own_folder", "n", F.inline(above)).join(sources, "folder")
    nearest = climbed.groupBy("own_folder", "n").agg(F.max_by(F.struct("inherited", "inherited_from"), "depth").alias("near"))
    nearest = staged(nearest.select("own_folder", "n", "near.*"), "license-folders")
    columns = ("path", "license", "similarity", "inherited", "inherited_from")
    rest = joined.where("license IS NOT NULL OR path IS NULL").withColumns({c: F.lit(None).cast("string") for c in columns[3:]})
    return lookup(bare, nearest, ["own_folder"], "n").select(*columns).unionByName(rest.select(*columns))
