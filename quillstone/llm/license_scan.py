"""License scans: notices by sparse TF-IDF cosine to templates, then inheritance along directories.

Every line of every file is a candidate; its terms are weighed by their rarity among the templates (a term of no template as the
rarest), and the template with the largest cosine of at least ``LEAST`` that shares ``COMMON`` terms with it is the line's. Lines that
have none of the telling terms cannot reach ``LEAST`` (Cauchy-Schwarz: the shared terms' part of a template's length bounds the
cosine), nor can lines whose length the templates' terms make too small a part of, so both are left out where they are read. A file's licence is that of its best line. A licence file stands
for its directory; files without a notice of their own inherit from the nearest directory above them that has one, found by
joining each file's ancestors with the directories.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table, written

# Names and notices of licences.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "MIT": "Released under the MIT License",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "Licensed under the GNU Lesser General Public License, version 3",
    "BSD-3-Clause": "Redistribution and use permitted under the BSD 3-Clause License",
    "MPL-2.0": "Subject to the terms of the Mozilla Public License, version 2.0",
    "CC-BY-4.0": "Licensed under Creative Commons CC BY 4.0",
    "CC-BY-SA-4.0": "Licensed under Creative Commons CC BY-SA 4.0",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
}
# Words so frequent in any text that they tell little; they count in the cosine like others.
FREQUENT = ("the", "of", "to", "this", "is", "under", "and", "by", "work", "use", "terms")
TERM = "[^a-z0-9.-]+"
LEAST = 0.6
#: Terms that a line must share with its template: the German "mit" alone is no licence.
COMMON = 2


def _terms(text):
    """Distinct terms of a line: runs of a-z, 0-9, point and hyphen, without points at the end."""
    parts = F.transform(F.split(ascii_lower(text), TERM), lambda t: F.regexp_replace(t, r"\.+$", ""))
    return F.array_distinct(F.filter(parts, lambda t: t != ""))


def _templates(spark: SparkSession, templates: dict[str, str]) -> tuple[DataFrame, float]:
    """license, term, weight (each template of length 1), idf; and the idf of a term that no template has."""
    rows = spark.createDataFrame([*templates.items()], "license string, notice string")
    terms = rows.select("license", F.explode(_terms(F.col("notice"))).alias("term"))
    n = len(templates)
    idf = terms.groupBy("term").agg((F.log(F.lit(float(n + 1)) / (F.count("*") + 1)) + 1).alias("idf"))
    terms = terms.join(F.broadcast(idf), "term")
    size = terms.groupBy("license").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("size"))
    return terms.join(F.broadcast(size), "license").select("license", "term", (F.col("idf") / F.col("size")).alias("weight"), "idf"), math.log(n + 1) + 1


def rarity(templates: dict[str, str]) -> tuple[dict[str, set], dict[str, float]]:
    """The terms of each template, and each term's idf."""
    terms = {k: {t.rstrip(".") for t in re.split(TERM, v.lower())} - {""} for k, v in templates.items()}
    n = Counter(t for found in terms.values() for t in found)
    return terms, {t: math.log((len(templates) + 1) / (c + 1)) + 1 for t, c in n.items()}


def telling(templates: dict[str, str], least: float) -> list[str]:
    """The templates' terms but the frequent ones, so far as the frequent ones alone cannot make a cosine of ``least``."""
    terms, idf = rarity(templates)
    quiet = set(FREQUENT)
    for found in terms.values():
        whole = sum(idf[t] ** 2 for t in found)
        for t in sorted(found & quiet, key=lambda t: (-idf[t], t)):
            if sum(idf[x] ** 2 for x in found & quiet) >= 0.99 * least**2 * whole:
                quiet.discard(t)
    return sorted(set(idf) - quiet)


def within_reach(terms, templates: dict[str, str], least: float):
    """Whether a line's distinct terms can reach ``least``: the templates' terms among them make up enough of its length."""
    idf, rare = rarity(templates)[1], math.log(len(templates) + 1) + 1
    known = F.array(*(F.lit(t) for t in idf))
    square = F.create_map(*(F.lit(x) for t, v in idf.items() for x in (t, v * v)))

    def enough(line, hits):
        part = F.aggregate(hits, F.lit(0.0), lambda a, t: a + F.element_at(square, t))
        return part >= 0.99 * least**2 * (part + rare**2 * (F.size(line) - F.size(hits)))

    return F.exists(F.array(terms), lambda line: F.exists(F.array(F.array_intersect(line, known)), lambda hits: enough(line, hits)))  # each worked out once


def notices(files: DataFrame, templates: dict[str, str] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """path, license, score: the best notice in each file that has one; ties to the smaller name.

    ``files``: path, text. Null texts have no lines.
    """
    known, rare = _templates(files.sparkSession, templates)
    vocabulary = known.groupBy("term").agg(F.max("idf").alias("idf"))
    cue = r"(^|[^a-z0-9.-])(" + "|".join(map(re.escape, telling(templates, least))) + r")\.*([^a-z0-9.-]|$)"
    lines = files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"[\r\n]+")).alias("line", "words")).where(ascii_lower(F.col("words")).rlike(cue))
    lines = lines.where(within_reach(_terms(F.col("words")), templates, least))
    terms = lines.select("path", "line", F.explode(_terms(F.col("words"))).alias("term")).distinct()
    weighed = terms.join(F.broadcast(vocabulary), "term", "left")  # the templates' terms, a fixed table
    size = weighed.groupBy("path", "line").agg(F.sqrt(F.sum(F.pow(F.coalesce("idf", F.lit(rare)), 2))).alias("size"))
    dots = weighed.where("idf is not null").select("path", "line", "term", "idf").join(F.broadcast(known.select("term", "license", "weight")), "term")
    dots = dots.groupBy("path", "line", "license").agg(F.sum(F.col("idf") * F.col("weight")).alias("dot"), F.count("*").alias("common")).where(F.col("common") >= COMMON)
    scored = dots.join(size, ["path", "line"]).select("path", "license", F.round(F.col("dot") / F.col("size"), 6).alias("score")).where(F.col("score") >= least)
    best = scored.groupBy("path").agg(F.min(F.struct((-F.col("score")).alias("s"), "license")).alias("b"))
    return best.select("path", F.col("b.license").alias("license"), (-F.col("b.s")).alias("score"))


def directory(path):
    return F.regexp_replace(path, "/[^/]*$", "")


def scanned(files: DataFrame, **kind) -> DataFrame:
    """path, license, score, origin (own, inherited or null), source_path for each row of ``files`` (path, text, is_notice).

    ``is_notice`` marks licence files. Of several in a directory the one with the best score counts, then the smallest path.
    A null path has no directory, so it inherits nothing and has no licence; null and empty texts have no lines; equal scores go to the
    smaller licence name; the rows of one path are scanned as one file, and all stay; lines of any length count whole; other columns
    are ignored, whatever their names; no rows give no rows.
    """
    found = written(notices(files.where("path is not null"), **kind), "license-notices")
    marked = files.where("is_notice and path is not null").select("path").distinct().join(found, "path")
    dirs = marked.groupBy(directory(F.col("path")).alias("dir")).agg(F.min(F.struct((-F.col("score")).alias("s"), "path", "license")).alias("b"))
    dirs = written(dirs.select("dir", F.col("b.path").alias("source_path"), F.col("b.license").alias("license"), (-F.col("b.s")).alias("score")), "license-dirs")
    paths = files.select("path", "is_notice")
    own = paths.join(found, "path", "left")
    bare = own.where("license is null and path is not null").select("path").distinct()
    depth = F.sequence(F.lit(1), F.size(F.split("path", "/")) - 1)
    above = bare.where(F.instr("path", "/") > 0).select("path", F.explode(depth).alias("depth"))
    above = above.select("path", "depth", F.array_join(F.slice(F.split("path", "/"), F.lit(1), F.col("depth")), "/").alias("dir"))
    nearest = above.join(dirs, "dir").groupBy("path").agg(F.max_by(F.struct("license", "score", "source_path"), "depth").alias("h"))
    joined = own.join(nearest, "path", "left")
    return joined.select(
        "path",
        F.coalesce("license", "h.license").alias("license"),
        F.coalesce("score", "h.score").alias("score"),
        F.when(F.col("license").isNotNull(), "own").when(F.col("h").isNotNull(), "inherited").alias("origin"),
        F.when(F.col("license").isNull(), F.col("h.source_path")).otherwise(F.col("path")).alias("source_path"),
    )


def titled(files: DataFrame, **kind) -> DataFrame:
    """path of the files whose first line of words is a notice, as in a licence's text or a file that only names its licence."""
    title = F.regexp_extract("text", r"^[\s]*([^\r\n]+)", 1)
    return notices(files.where("text is not null").select("path", title.alias("text")), **kind).select("path")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as files: source/lang/doc_id; those that begin with a notice stand for their directory."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat_ws("/", F.coalesce("source", F.lit("-")), F.coalesce("lang", F.lit("-")), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))
    files = docs.select("doc_id", path.alias("path"), "text")
    heads = written(titled(files), "license-titles").withColumn("is_notice", F.lit(True))
    found = scanned(files.join(heads, "path", "left").withColumn("is_notice", F.coalesce("is_notice", F.lit(False))))
    return found.select(F.expr("try_cast(substring_index(path, '/', -1) as bigint)").alias("doc_id"), "path", "license", "score", "origin", "source_path")


def _oracle() -> str:
    values = ", ".join(f"('{k}', '{v}')" for k, v in TEMPLATES.items())
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    terms = "list_distinct(list_filter(list_transform(string_split_regex({}, '[^a-z0-9.-]+'), lambda t: regexp_replace(t, '\\.+$', '')), lambda t: t <> ''))"
    return f"""
with t as (select * from (values {values}) v(license, notice)),
tt as (select license, unnest({terms.format(lower.format("notice"))}) as term from t),
idf as (select term, ln({len(TEMPLATES) + 1}.0::double / (count(*) + 1)) + 1 as idf from tt group by term),
ts as (select license, sqrt(sum(idf * idf)) as size from tt join idf using (term) group by license),
tw as (select license, term, idf / size as weight from tt join idf using (term) join ts using (license)),
f as (select concat_ws('/', coalesce(source, '-'), coalesce(lang, '-'), coalesce(doc_id::varchar, '-')) as path, text from documents),
l0 as (select path, string_split_regex(coalesce(text, ''), '[\\r\\n]+') as ls from f),
l1 as (select path, unnest(ls) as words, generate_subscripts(ls, 1) as line from l0),
fl as (select path, min(line) as line from l1 where regexp_matches(words, '\\S') group by path),
lt as (select distinct path, line, term from (select path, line, unnest({terms.format(lower.format("words"))}) as term from l1)),
w as (select lt.*, idf from lt left join idf using (term)),
sz as (select path, line, sqrt(sum(pow(coalesce(idf, ln({len(TEMPLATES) + 1}.0::double) + 1), 2))) as size from w group by path, line),
d as (select path, line, license, sum(idf * weight) as dot from w join tw using (term) group by path, line, license having count(*) >= {COMMON}),
s as (select path, line, license, round(dot / size, 6) as score from d join sz using (path, line) where round(dot / size, 6) >= {LEAST}),
n as (select * from (select *, row_number() over (partition by path order by score desc, license) as r from s) where r = 1),
m as (select distinct f.path, license, score, regexp_replace(f.path, '/[^/]*$', '') as dir from f join n using (path) where exists (select 1 from s join fl using (path, line) where s.path = f.path)),
dirs as (select * from (select *, row_number() over (partition by dir order by score desc, path) as r from m) where r = 1),
b as (select distinct f.path from f left join n using (path) where n.license is null),
a as (select path, unnest(range(1, len(string_split(path, '/')))) as depth from b),
h as (select * from (select a.path, depth, dirs.license, dirs.score, dirs.path as source_path,
  row_number() over (partition by a.path order by depth desc) as r
  from a join dirs on dirs.dir = array_to_string(string_split(a.path, '/')[1:depth], '/')) where r = 1)
select try_cast(string_split(f.path, '/')[-1] as bigint) as doc_id, f.path, coalesce(n.license, h.license) as license, coalesce(n.score, h.score) as score,
  case when n.license is not null then 'own' when h.license is not null then 'inherited' end as origin,
  case when n.license is not null then f.path else h.source_path end as source_path
from f left join n using (path) left join h using (path)
"""


ORACLE_SQL = _oracle()
