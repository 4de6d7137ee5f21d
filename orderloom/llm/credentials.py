"""Secrets in texts: sure ones, and parts of credentials that only count together.

Three kinds are sure and always reported: a value assigned to a telling name, an access identifier, a long
run of hexadecimal digits. Other parts are weak: values of mixed characters or assigned to a vaguer name
(``secret``), user names and mail addresses (``identity``), and addresses of services (``endpoint``). A weak
part is reported only if parts that complete it lie in its scope: the same paragraph (blank lines part
these), at most ``REACH`` code points away.

* a weak secret needs an access identifier, or an identity and an endpoint;
* an identity needs a sure secret, or a weak secret and an endpoint;
* an endpoint needs a secret and an identifier or identity.

Parts become rows. Scopes are joined as intervals: each part is entered in cells of ``REACH`` code points,
reduced to the first begin and last end per cell and sort of part, and weak parts look into the cells they
reach. So parts are never paired with each other, however many a text holds, and only rows of texts with
parts are shuffled. Everything is column expressions.

Results for odd input: a NULL text is empty and has no spans; spans count code points of the whole text;
a repeated row or id is searched again; an empty table gives an empty result. Only the named columns are
read, so others may have any name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orderloom.llm.common import let, staged

REACH = 200
SURE = ("assign", "access", "hex")
KINDS = (*SURE, "secret", "identity", "endpoint")
BREAK = len(KINDS)

_VALUE = r"""["']?\x20*[:=]\x20*["']?"""


def _names(names: str) -> str:
    """The alternatives ``names``, letters in either case (of A-Z alone)."""
    return "(?:" + "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in names) + ")"


# The sure kinds. Runs of hexadecimal digits and access identifiers that are too short hold
# no longer ones, so their least length may stand in the pattern; assignments are dropped after matching.
ASSIGN = _names("password|passwd|secret|token|api_?key") + _VALUE + r"[A-Za-z0-9+/_.=-]+"
SHORT_ASSIGN = "^" + _names("password|passwd|secret|token|api_?key") + _VALUE + r"[A-Za-z0-9+/_.=-]{6,}$"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

MIXED = r"[A-Za-z0-9+/_-]{16,}"
VAGUE = _names("pass|pwd|auth|credential|private_?key|access_?key") + _VALUE + r"[A-Za-z0-9+/_.=-]{6,}"
NAMED = _names("user|username|login|account|client_?id") + _VALUE + r"[A-Za-z0-9@_.-]{3,}"
MAIL = r"[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9.-]{0,252}[A-Za-z0-9]"
URL = r"""[a-z][a-z0-9+-]{1,15}://[^\x20\x09-\x0D"'<>]+"""
ADDRESS = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
BLANK = r"\n[\x20\x09\r]*\n"


def _found(kind: int, text: str, pattern: str, kept=None, only_if: Column | None = None) -> Column:
    """Array of (kind, place, gap to the match before, length, kept) for the matches of ``pattern`` from left to right."""
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,kept:boolean>>")

    def measured(matches: Column) -> Column:
        spans = let(F.split(F.col(text), pattern, -1), lambda gaps: F.transform(matches, lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("size"),
            (kept(m) if kept else F.lit(True)).alias("kept"))))
        return F.when(F.size(matches) > 0, spans).otherwise(none)

    matches = let(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), measured)
    return matches if only_if is None else F.when(only_if, matches).otherwise(none)


def _mixed(m: Column) -> Column:
    """Digits with both cases, or hexadecimal digits of both sorts in a run too short to be sure."""
    digit, lower = m.rlike("[0-9]"), m.rlike("[a-z]")
    return digit & lower & (m.rlike("[A-Z]") | m.rlike("^[0-9a-f]{16,23}$"))


def parts(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, id, groups): per row arrays of matches by pattern. Weak parts and blank lines only where a text
    has both a secret and an identifier of any sort, as no other text can complete one."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    has = rows.text.contains
    rows = rows.select(
        "*",
        _found(0, "text", ASSIGN, lambda m: m.rlike(SHORT_ASSIGN)).alias("assign"), _found(1, "text", ACCESS, only_if=has("AKIA")).alias("access"),
        _found(2, "text", HEX).alias("hex"), _found(4, "text", MAIL, only_if=has("@")).alias("mail"), _found(4, "text", NAMED).alias("named"),
    )
    rows = rows.withColumn("identified", F.size("access") + F.size("mail") + F.size("named") > 0)
    some = F.col("identified")
    rows = rows.select(
        "*", _found(3, "text", MIXED, _mixed, some).alias("mixed"), _found(3, "text", VAGUE, only_if=some).alias("vague"))
    secrets = reduce(lambda a, b: a + b, (F.size(c) for c in ("assign", "hex", "mixed", "vague")))
    rows = rows.withColumn("whole", some & (secrets > 0))
    whole = F.col("whole")
    rows = rows.select(
        "*", _found(5, "text", URL, only_if=whole & F.col("text").contains("://")).alias("url"), _found(5, "text", ADDRESS, only_if=whole).alias("address"),
        _found(BREAK, "text", BLANK, only_if=whole).alias("blank"),
    )
    weak = F.when(whole, F.array("mixed", "vague", "mail", "named", "url", "address", "blank"))
    groups = F.filter(F.concat(F.array("assign", "access", "hex"), F.coalesce(weak, F.array())), lambda g: F.size(g) > 0)
    return rows.select("row", "id", groups.alias("groups"))


def spans(found: DataFrame) -> DataFrame:
    """(row, kind, start, end, scope, inside): every part that counts; ``inside`` if a weak one meets a sure one."""
    each = found.select("row", F.posexplode("groups").alias("g", "matches")).select("row", "g", F.inline("matches"))
    so_far = Window.partitionBy("row", "g").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    each = each.repartition("row").withColumn("end", F.sum(F.col("gap") + F.col("size")).over(so_far)).where("kept")
    each = each.select("row", "kind", (F.col("end") - F.col("size")).alias("start"), "end")
    place = Window.partitionBy("row").orderBy("start", "kind", "end")
    before, after = place.rowsBetween(Window.unboundedPreceding, 0), place.rowsBetween(0, Window.unboundedFollowing)
    sure, weak = F.col("kind") < len(SURE), F.col("kind").between(len(SURE), BREAK - 1)
    each = each.select(
        "*", F.sum((F.col("kind") == BREAK).cast("int")).over(before).alias("scope"),
        F.max(F.when(sure, F.col("end"))).over(before).alias("last"), F.min(F.when(sure, F.col("start"))).over(after).alias("next"),
    )
    meets = weak & (F.coalesce(F.col("last") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False)))
    return each.where(F.col("kind") != BREAK).select("row", "kind", "start", "end", "scope", meets.alias("inside"))


def linked(each: DataFrame, reach: int = REACH) -> DataFrame:
    """(row, kind, start, end) of the weak parts that others complete."""
    each = each.where("NOT inside")
    first, last = F.floor(F.col("start") / reach), F.floor((F.col("end") - 1) / reach)
    cells = each.select("row", "scope", "kind", "start", "end", F.explode(F.sequence(first, last)).alias("cell"))
    cells = cells.groupBy("row", "scope", "cell", "kind").agg(F.min("start").alias("from"), F.max("end").alias("to"))
    weak = each.where(F.col("kind") >= len(SURE))
    near, far = F.floor(F.greatest(F.col("start") - reach, F.lit(0)) / reach), F.floor((F.col("end") + reach - 1) / reach)
    looks = weak.select("row", "scope", F.col("kind").alias("weak"), "start", "end", F.explode(F.sequence(near, far)).alias("cell"))
    met = looks.join(cells, ["row", "scope", "cell"]).where((F.col("from") < F.col("end") + reach) & (F.col("to") > F.col("start") - reach))
    has = [F.max(F.col("kind") == k).alias(f"has_{name}") for k, name in enumerate(KINDS)]
    met = met.groupBy("row", "weak", "start", "end").agg(*has)
    complete = (
        (F.col("weak") == 3) & F.expr("has_access OR has_identity AND has_endpoint")
        | (F.col("weak") == 4) & F.expr("has_assign OR has_hex OR has_secret AND has_endpoint")
        | (F.col("weak") == 5) & F.expr("(has_assign OR has_hex OR has_secret) AND (has_access OR has_identity)")
    )
    return met.where(complete).select("row", F.col("weak").alias("kind"), "start", "end")


def find(docs: DataFrame, id: str = "doc_id", text: str = "text", reach: int = REACH) -> DataFrame:
    """Per row: id, n_assign, n_access, n_hex, and ``found``: all spans (start, kind, end) in order, kinds as in ``KINDS``."""
    found = staged(parts(docs, id, text), "credentials-parts")
    each = staged(spans(found.where("size(groups) > 0")), "credentials-spans")
    counted = each.where(F.col("kind") < len(SURE)).select("row", "kind", "start", "end").union(linked(each, reach))
    spot = F.struct("start", "kind", "end")
    gathered = counted.groupBy("row").agg(F.sort_array(F.collect_set(spot)).alias("found"))
    with_parts = found.where("size(groups) > 0").select("row", "id").join(gathered, "row", "left").select("id", "found")
    without = found.where("size(groups) = 0").select("id", F.lit(None).cast(gathered.schema["found"].dataType).alias("found"))
    rows = with_parts.union(without).withColumn("found", F.coalesce("found", F.array()))

    def count(kind: int) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(SURE)]
    return rows.select(F.col("id").alias(id), *counts, "found")


def shown(found: str, kinds: int = len(KINDS)) -> Column:
    """``kind:start:end`` of the first ``kinds`` kinds, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    kept = F.filter(found, lambda s: s["kind"] < kinds)
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
