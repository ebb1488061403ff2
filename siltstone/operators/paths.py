"""Paths: hierarchy, ignore rules, safe joins, parts of archives."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.files import folder_of

RULES_DDL = "dir string, ord int, pattern string, regex string, negated boolean, dir_only boolean"


def hierarchy(path: Column | str) -> Column:
    """All directories above a path, the root ("") first."""
    parts = F.filter(F.split(folder_of(path), "/"), lambda p: p != "")
    return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def glob_regex(pattern: str) -> tuple[str, bool, bool] | None:
    """(regex over a path relative to the rule file, negated, for directories only), or None for a comment, a blank line, or a pattern that is none, such as [z-a]."""
    line = pattern.rstrip("\r\n")
    line = re.sub(r"(?<!\\) +$", "", line)
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    line = line[1:] if line[:2] in ("\\#", "\\!") else line
    dir_only = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    line = line.lstrip("/")
    out, i = "", 0
    while i < len(line):
        if line.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif line.startswith("/**", i) and i + 3 == len(line):
            out, i = out + "/.*", i + 3
        elif line[i] == "*":
            out, i = out + "[^/]*", i + 1
            while i < len(line) and line[i] == "*":
                i += 1
        elif line[i] == "?":
            out, i = out + "[^/]", i + 1
        elif line[i] == "[" and "]" in line[i + 1 :]:
            end = line.index("]", i + 1)
            body = line[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[:1] == "!" else body).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(line[i]), i + 1
    regex = ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if dir_only else "(?:/.*)?$")
    try:
        re.compile(regex)
    except re.error:
        return None
    return regex, negated, dir_only


def ignore_rules(rule_files: dict[str, str]) -> list[tuple]:
    """Rows of RULES_DDL from texts of rule files by directory ("" is the root)."""
    rows = []
    for directory, text in sorted(rule_files.items()):
        for i, line in enumerate(text.split("\n")):
            if rule := glob_regex(line):
                rows.append((directory, i, line, *rule))
    return rows


def discover_rules(files: DataFrame) -> dict[str, str]:
    """Texts of the rule files in ``files``; their number is bounded by the tree's directories, and is collected."""
    found = files.where(F.element_at(F.split("rel_path", "/"), -1) == ".gitignore").select("folder", F.decode("content", "UTF-8").alias("text"))
    return {r["folder"]: r["text"] for r in found.collect()}


def ignored(paths: DataFrame, rules: DataFrame, path: str = "rel_path") -> DataFrame:
    """(path, ignored) for each distinct path: any directory above whose rule file matches; within a file the last rule that matches counts.

    The prefix join of rules and paths is an equality join on the exploded hierarchy. Rules
    are broadcast by Spark where they are small.
    """
    distinct = paths.select(F.col(path).alias("p")).distinct()
    above = distinct.select("p", F.explode(hierarchy("p")).alias("dir"))
    relative = F.when(F.col("dir") == "", F.col("p")).otherwise(F.expr("substring(p, length(dir) + 2)"))
    hits = above.join(rules, "dir").where(F.regexp(relative, F.col("regex")))
    verdict = hits.groupBy("p", "dir").agg(F.max_by("negated", "ord").alias("last")).groupBy("p").agg(F.bool_or(~F.col("last")).alias("hit"))
    return distinct.join(verdict, "p", "left").select(F.col("p").alias(path), F.coalesce("hit", F.lit(False)).alias("ignored"))


def pruned_directories(directories: DataFrame, rules: DataFrame, path: str = "rel_path") -> DataFrame:
    """(path, pruned): directories that match with a slash behind them and not without."""
    plain = ignored(directories, rules, path)
    slashed = ignored(directories.select(F.concat(path, F.lit("/")).alias(path)), rules, path)
    slashed = slashed.select(F.expr(f"substring({path}, 1, length({path}) - 1)").alias(path), F.col("ignored").alias("with_slash"))
    return plain.join(slashed, path).select(path, (F.col("with_slash") & ~F.col("ignored")).alias("pruned"))


def kept_files(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``files`` without the ignored ones and those below a pruned directory."""
    gone = ignored(files, rules).where("ignored").select("rel_path")
    folders = files.select("rel_path", F.explode(hierarchy("rel_path")).alias("d")).where("d <> ''")
    pruned = pruned_directories(folders.select("d").distinct(), rules, "d").where("pruned").select("d")
    below = folders.join(pruned, "d", "left_semi").select("rel_path")
    return files.join(gone.unionByName(below).distinct(), "rel_path", "left_anti")


def cleaned(path: Column) -> Column:
    """An absolute path with . and .. folded away."""
    push = lambda a, p: F.when(p.isin("", "."), a).when(p == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), push), "/"))


def safe_join(base: str, entry: Column) -> Column:
    """The entry below an absolute base, or null if it would leave it."""
    root = "/" + "/".join(p for p in base.split("/") if p not in ("", "."))
    joined = cleaned(F.concat(F.lit(root + "/"), entry))
    return F.when((joined == root) | joined.startswith("/" if root == "/" else root + "/"), joined)


def archive_parts(names: DataFrame, name: str = "name", ending: str = "zip") -> DataFrame:
    """(base, part, name) of the parts of multi-part archives, up to the first gap and to 99.

    A set that lacks part 1 counts as single files of its own, each part 1 of itself.
    """
    pattern = rf"^(.*)_(\d{{2}})\.{re.escape(ending)}$"
    numbered = names.select(F.col(name).alias("name"), F.regexp_extract(name, pattern, 1).alias("base"), F.regexp_extract(name, pattern, 2).try_cast("int").alias("part")).where("part BETWEEN 1 AND 99")
    whole = numbered.withColumn("nth", F.row_number().over(W.partitionBy("base").orderBy("part"))).withColumn("least", F.min("part").over(W.partitionBy("base")))
    parts = whole.where("least = 1 AND nth = part").select("base", "part", "name")
    lone = whole.where("least > 1").select(F.expr(f"substring(name, 1, length(name) - {len(ending) + 1})").alias("base"), F.lit(1).alias("part"), "name")
    return parts.unionByName(lone)
