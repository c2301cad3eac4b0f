"""The rule string: parsing, normal form, ids, verbalisation. Column functions unless the name says text."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An atom: relation names may hold parentheses and commas, so the three arguments anchor it. (?U): words beyond ASCII.
ATOM = r"(?U)([\w\s'\-\.,\(\)]+)\((\w+),\s*(\w+),\s*(\w+)\)(?:&|$)"
ATOM_TEXT = re.compile(r"([\w\s'\-\.,\(\)]+)\((\w+),\s*(\w+),\s*(\w+)\)(&|$)")
NUMBERING = r"^\d+\.\s+"


def normal(rule: Column) -> Column:
    """One space on either side of the arrow, none around ampersands, runs of white space as one space."""
    out = F.regexp_replace(F.trim(rule), r"\s*<-\s*", " <- ")
    out = F.regexp_replace(out, r"\s*&\s*", "&")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def rule_id(rule: Column) -> Column:
    """The first 12 hex digits of the SHA-1 of the normal form."""
    return F.substring(F.sha1(normal(rule)), 1, 12)


def _atoms(rule: Column, group: int) -> Column:
    return F.regexp_extract_all(F.regexp_replace(normal(rule), " ?<- ?", "&"), F.lit(ATOM), F.lit(group))


def relations(rule: Column) -> Column:
    """The relation names, the head first."""
    return F.transform(_atoms(rule, 1), lambda x: F.trim(x))


def parsed(df: DataFrame, column: str = "rule") -> DataFrame:
    """df with head, body (names in text order) and var_constraints of its rule strings."""
    names, left, right = relations(F.col(column)), _atoms(F.col(column), 2), _atoms(F.col(column), 3)
    out = df.withColumn("atoms", names).withColumn("left", left).withColumn("right", right)
    vars_ = "concat(slice(left, 2, size(left) - 1), array(right[size(right) - 1]))"
    return out.select(
        *df.columns, F.expr("atoms[0]").alias("head"), F.expr("slice(atoms, 2, size(atoms) - 1)").alias("body"), F.expr(var_constraints_sql(vars_)).alias("var_constraints")
    )


def var_constraints_sql(entities: str) -> str:
    """Groups of two or more positions that share an entity, sorted."""
    return f"array_sort(filter(transform(array_distinct({entities}), e -> filter(sequence(0, size({entities}) - 1), p -> ({entities})[p] = e)), g -> size(g) > 1))"


def normal_constraints_sql(groups: str, length: str) -> str:
    """Groups and singletons of all positions 0..length, each sorted, in order."""
    single = f"transform(filter(sequence(0, {length}), p -> not exists({groups}, g -> array_contains(g, p))), p -> array(p))"
    return f"array_sort(concat(transform({groups}, g -> array_sort(g)), {single}))"


def canonical(head: str = "head", body: str = "body", groups: str = "var_constraints", arrow: str = " <- ") -> Column:
    """Head(X0,Xl,Tl) <- B1(X0,X1,T0)&...: a position is named by the place of its group among all groups and singletons, sorted."""
    last = f"size({body})"

    def name(p: str) -> str:
        return f"concat('X', cast(array_position(transform(named, g -> array_contains(g, {p})), true) - 1 as string))"

    atoms = f"transform({body}, (r, i) -> concat(r, '(', {name('i')}, ',', {name('i + 1')}, ',T', cast(i as string), ')'))"
    text = f"concat({head}, '(X0,', {name(last)}, ',T', cast({last} as string), ')', '{arrow}', array_join({atoms}, '&'))"
    return F.expr(f"element_at(transform(array({normal_constraints_sql(groups, last)}), named -> {text}), 1)")


def verbalised(rule: Column, conf: str = "conf", supp: str = "rule_supp", body: str = "body_supp") -> Column:
    """The rule behind its measures, in fixed columns."""
    return F.concat(F.format_string("%8.6f  %4d  %4d  ", F.col(conf), F.col(supp), F.col(body)), rule)


def without_measures(line: Column) -> Column:
    return F.regexp_replace(line, r"^\s*[\d.]+\s+\d+\s+\d+\s+", "")


def body_length(rule: Column) -> Column:
    return F.size(F.filter(F.split(F.element_at(F.split(rule, "<-"), 2), "&"), lambda x: F.trim(x) != ""))


def path_tokens(path: Column, body_only: bool = True) -> Column:
    """The relation tokens of a rule string, of its body only if it has one."""
    part = F.when(F.instr(path, "<-") > 0, F.element_at(F.split(path, "<-"), 2)).otherwise(path) if body_only else F.regexp_replace(path, "<-", "&")
    return F.transform(F.regexp_extract_all(part, F.lit(ATOM), F.lit(1)), lambda x: F.trim(x))


def path_rule(head: Column, path: Column) -> Column:
    """head(X,Y) <- r1(X,Z_1)&r2(Z_1,Y) of a path of relations."""
    n = F.size(path)

    def variable(i: Column) -> Column:
        return F.when(i == 0, "X").when(i == n, "Y").otherwise(F.concat(F.lit("Z_"), i.cast("string")))

    atoms = F.transform(path, lambda r, i: F.concat(r, F.lit("("), variable(i), F.lit(","), variable(i + 1), F.lit(")")))
    return F.concat(head, F.lit("(X,Y) <- "), F.array_join(atoms, "&"))


def relation_list(names: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(names)), ";")


def clean_name(name: Column, paths: dict[str, str] | None = None) -> Column:
    """A relation's name for a reader: outer underscores go; then a name with / is looked up in paths (and stays as it is if
    that lacks it), inner _ or else & become spaces, or else capitals begin words and the name is in small letters."""
    bare = F.regexp_replace(name, "^_+|_+$", "")
    plain = F.regexp_replace(bare, "^inverse ", "")
    known = F.create_map(*[F.lit(x) for kv in paths.items() for x in kv])[plain] if paths else F.lit(None).cast("string")
    of_path = F.when(bare.startswith("inverse "), F.concat(F.lit("inverse "), known)).otherwise(known)
    camel = F.lower(F.regexp_replace(bare, "(?<!^)(?=[A-Z])", " "))
    return F.when(bare.contains("/"), F.coalesce(of_path, bare)).when(bare.contains("_"), F.replace(bare, F.lit("_"), F.lit(" "))).when(bare.contains("&"), F.replace(bare, F.lit("&"), F.lit(" "))).otherwise(camel)


def extracted(line: Column) -> Column:
    """A line's rule without its numbering, null if it holds none."""
    return F.when(line.rlike("<-"), F.trim(F.regexp_replace(line, NUMBERING, "")))


def first_json(text: Column, schema: str) -> Column:
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)


def percent(value: Column) -> Column:
    return F.concat(F.format_string("%.1f", value * 100), F.lit("%"))


def short_number(value: Column) -> Column:
    """At most four digits after the point, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.4f", value), "0+$", ""), r"\.$", "")


def hours_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("HOUR", start, end)


def rule_id_text(rule: str) -> str:
    rule = re.sub(r"\s*&\s*", "&", re.sub(r"\s*<-\s*", " <- ", rule.strip()))
    return hashlib.sha1(re.sub(r"\s+", " ", rule).strip().encode()).hexdigest()[:12]


def config_id(config: dict) -> str:
    return hashlib.sha1(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:8]


def to_bool(text: str) -> bool:
    value = text.strip().lower()
    if value in ("true", "1", "yes", "y", "t"):
        return True
    if value in ("false", "0", "no", "n", "f"):
        return False
    raise ValueError(f"not a boolean: {text}")


def within_length(items: DataFrame, by: str, order: str, text: str, limit: int) -> DataFrame:
    """The first items of each group whose lengths sum to at most limit."""
    from pyspark.sql import Window

    total = F.sum(F.length(text)).over(Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return items.withColumn("total", total).where(F.col("total") <= limit).drop("total")
