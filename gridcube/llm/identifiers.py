"""Personal identifiers by bootstrapped contextual extraction.

Strict patterns give seed entities. The words around the seeds are lexical
patterns; patterns and the identifier-like strings (instances) they surround
form a bipartite graph, which Spark scores over a few rounds: a pattern is as
confident as the share of its instances that are trusted, an instance as
trusted as its confident patterns make it. Strings that become trusted are
added as spans; the seeds always stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridcube.llm.common import cut, need, stage

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Looser shapes that only a pattern or a trusted twin can confirm.
_LOOSE = (("email", re.compile(r"(?<![^\s<(\[,;:\"'])[^\s<>()\[\],;:\"'@]{1,64}@[^\s<>()\[\],;:\"'@]{1,255}(?<![.!?])")),
          ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){2,7}:?[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
          (None, re.compile(r"(?<![\w.+-])\(?[0-9](?:[ ().-]{0,2}[0-9]){6,18}(?![\w])")))
_WORD = re.compile(r"\S+")


def _luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _number(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each ``@`` once: the run of local characters before it (never reaching
    into an earlier match) and the domain behind it, in linear time."""
    done = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = max(at + 1, done)


def seeds(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the strict matches, by kind, then start."""
    out = [(0, *span) for span in emails(text)] if "@" in text else []
    if any(d in text for d in "0123456789"):
        out += [(1, *m.span()) for m in _DOTTED.finditer(text)
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        out += [(2, *m.span()) for m in _DIGITS.finditer(text)
                if 13 <= len(n := _number(m.group())) <= 19 and _luhn(n)]
        if "+" in text:
            out += [(3, *m.span()) for m in _PLUS.finditer(text) if 9 <= len(_number(m.group())) <= 15]
    return out


def loose(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Identifier-like strings that touch no seed, leftmost first."""
    if "@" not in text and not any(d in text for d in "0123456789"):
        return []
    used = sorted((a, b) for _, a, b in taken)
    found = []
    for kind, shape in _LOOSE:
        for m in shape.finditer(text):
            number = len(_number(m.group()))
            k = KINDS.index(kind or ("card" if number >= 13 else "phone"))
            found.append((m.start(), m.end(), k))
    out, end, u = [], 0, 0
    for a, b, k in sorted(found):
        while u < len(used) and used[u][1] <= a:
            u += 1
        if a >= end and not (u < len(used) and used[u][0] < b):
            out.append((k, a, b))
            end = b
    return out


def context(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a span: the two words before it, and the word before
    with the word after. The line's ends stand for missing words: behind a single
    word at the line's end, and before the words of a line that the span begins."""
    before = text[max(0, start - 80):start].split("\n")[-1].lower().split()[-2:]
    after = text[end:end + 40].split("\n")[0].lower().split()[:2]
    out = []
    if len(before) == 2:
        out.append("before " + " ".join(before))
    if before and after:
        out.append(f"between {before[-1]} | {after[0]}")
    elif len(before) == 1:
        out += [f"ending {before[0]} |", f"label | {before[0]}"]
    elif after and not before:
        out += [f"beginning | {after[0]}", "after " + " ".join([*after, "|"][:2])]
    return out


def _instance(kind: int, text: str) -> str:
    """What makes two writings of an identifier the same one."""
    return _number(text) if kind >= 2 else text.lower()


_MENTION = "array<struct<kind:int,start:int,end:int,seed:boolean,instance:string,patterns:array<string>>>"
_ARROW_MENTION = pa.list_(pa.struct([
    ("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()),
    ("instance", pa.string()), ("patterns", pa.list_(pa.string()))]))


def mentions(text: str | None) -> list[dict]:
    if not text:
        return []
    sure = seeds(text)
    return [{"kind": k, "start": a, "end": b, "seed": seed, "instance": _instance(k, text[a:b]), "patterns": context(text, a, b)}
            for seed, spans in ((True, sure), (False, loose(text, sure))) for k, a, b in spans]


def _mentions(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([mentions(t) for t in texts.to_pylist()], type=_ARROW_MENTION)


def trusted_instances(found: DataFrame, *, rounds: int = 3, support: int = 5, pattern_confidence: float = 0.8,
                      instance_confidence: float = 0.9) -> DataFrame:
    """(kind, instance) that the graph of ``found(kind, instance, seed,
    pattern)`` confirms, seeds included. Edges are distinct, sums are partial
    aggregates; each round is two joins, by instance and by pattern."""
    edges = cut(found.where("pattern is not null").groupBy("kind", "instance", "pattern").agg(F.max("seed").alias("seed")))
    trust = found.groupBy("kind", "instance").agg(F.max(F.col("seed").cast("double")).alias("trust")).where("trust > 0")
    for _ in range(rounds):
        patterns = edges.join(trust, ["kind", "instance"], "left").groupBy("kind", "pattern").agg(
            F.sum(F.coalesce("trust", F.lit(0.0))).alias("sure"), F.count("*").alias("n"))
        good = patterns.where((F.col("sure") >= support) & (F.col("sure") >= pattern_confidence * F.col("n"))) \
            .select("kind", "pattern", (F.col("sure") / F.col("n")).alias("conf"))
        raised = edges.where("not seed").join(good, ["kind", "pattern"]).groupBy("kind", "instance").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("conf") * F.lit(0.95)))))).alias("trust"))
        sure = trust.where("trust = 1")
        now = sure.unionByName(raised.where(F.col("trust") >= instance_confidence).join(sure, ["kind", "instance"], "left_anti"))
        trust = cut(now)
    return trust


def find_identifiers(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", **scoring) -> DataFrame:
    """One row per document: (id, seeds, added), each an array of (kind, start,
    end) with kinds numbered as in ``KINDS`` and code-point positions, end
    exclusive, ordered by kind, then start.

    ``scoring`` goes to :func:`trusted_instances`. Added spans never touch a
    seed. Null and empty texts have no spans; repeated rows (or ids) are scored
    once each for their spans but count once for an instance and pattern; null
    ids are kept; an empty table gives an empty result. Only the two named
    columns are read.
    """
    need(docs, id_col, text)
    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.arrow_udf(_mentions, _MENTION)(F.col(f"`{text}`").cast("string")).alias("found"))
    # numbered once, as it is written, so that the number stays with its row
    rows = stage(read.withColumn("row", F.monotonically_increasing_id()), "identifiers")
    every = rows.select("row", F.explode("found").alias("m")).select("row", "m.*")
    graph = every.select("kind", "instance", "seed", F.explode_outer("patterns").alias("pattern"))
    trust = trusted_instances(graph, **scoring)
    added = every.where("not seed").join(trust.select("kind", "instance"), ["kind", "instance"], "left_semi") \
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("added"))
    span = lambda m: F.struct(m["kind"].alias("kind"), m["start"].alias("start"), m["end"].alias("end"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    return rows.join(added, "row", "left").select(
        F.col("id").alias(id_col), F.transform(F.filter("found", lambda m: m["seed"]), span).alias("seeds"),
        F.coalesce("added", none).alias("added"))


def of_kind(name: str):
    """Condition on a span, for ``F.filter``."""
    return lambda m: m["kind"] == KINDS.index(name)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda m: F.concat_ws(":", F.get(names, m["kind"]), m["start"], m["end"])), ",")
