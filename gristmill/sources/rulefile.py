"""Rule files of lines: ``header``, ``mimeheader``, ``body``, ``rawbody``, ``full``, ``uri``, ``meta``, ``score``, ``describe`` and ``tflags``.

The lines become one compiled plan: every pattern is one predicate over a
message row, so all patterns run in one scan, and ``meta`` rules run in layers
over what they found. Rules whose names begin with two underscores serve other
rules and are not reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.operators import layers

#: Score of a rule without a ``score`` line.
DEFAULT_SCORE = 1.0
_PATTERN = re.compile(r"^(?:m(?P<brace>\{)(?P<inside>.*)\}|m?(?P<mark>[^\w\s{])(?P<text>.*)(?P=mark))(?P<flags>[a-z]*)$", re.S)
_HEADER = re.compile(r"^(?P<name>[A-Za-z0-9_-]+(?::[a-z]+)*)\s*(?P<op>=~|!~)\s*(?P<pattern>.*)$")
_UNSET = re.compile(r"\s*\[if-unset:\s*(.*?)\]\s*$")
_LINK = r"(?i)\b(?:https?|ftp)://[^\s<>\x22']+"


@dataclass
class FileRule:
    """One pattern rule: where it looks, the Java regular expression, and whether it is met by no match."""

    name: str
    kind: str
    target: str = ""
    pattern: str = ""
    negated: bool = False
    unset: str | None = None


@dataclass
class RuleSet:
    """What a file says: pattern rules, meta rules, scores and descriptions, and the lines that were not understood."""

    rules: dict[str, FileRule] = field(default_factory=dict)
    metas: dict[str, str] = field(default_factory=dict)
    scores: dict[str, float] = field(default_factory=dict)
    texts: dict[str, str] = field(default_factory=dict)
    flags: dict[str, list[str]] = field(default_factory=dict)
    skipped: list[str] = field(default_factory=list)

    def score(self, name: str) -> float:
        default = -DEFAULT_SCORE if "nice" in self.flags.get(name, ()) else DEFAULT_SCORE
        return self.scores.get(name, default)


def java_pattern(text: str) -> str | None:
    """``/re/flags``, ``m{re}flags`` or ``m!re!flags`` as a Java pattern; None if it is not one."""
    m = _PATTERN.match(text.strip())
    if not m:
        return None
    body = m["inside"] if m["brace"] else m["text"]
    flags = "".join(f for f in "imsx" if f in m["flags"])
    if m["mark"]:
        body = body.replace("\\" + m["mark"], m["mark"] if m["mark"] in "/!#,;:%@~'\"" else "\\" + m["mark"])
    return f"(?{flags}){body}" if flags else body


def load(lines: Iterable[str]) -> RuleSet:
    """Read a rule file. A later line of a name replaces an earlier one; ``ifplugin`` blocks are read as if the plugin were there.

    Blank lines and comments do not count; ``eval:`` tests and lines that are not
    understood are in ``skipped``. Of several scores on a line the last counts.
    """
    out = RuleSet()
    for line in lines:
        text = re.sub(r"(?<!\\)#.*$", "", line).strip() if not re.match(r"\s*(header|mimeheader|body|rawbody|full|uri)\s", line) else line.strip()
        words = text.split(None, 2)
        if not words or words[0] in ("ifplugin", "if", "endif", "else", "loadplugin"):
            continue
        kind, name, rest = words[0], words[1] if len(words) > 1 else "", words[2].strip() if len(words) > 2 else ""
        rule = None
        if kind in ("header", "mimeheader"):
            exists, m = re.fullmatch(r"exists:\s*([A-Za-z0-9_-]+)", rest), _HEADER.match(rest)
            if exists:
                rule = FileRule(name, "exists", exists[1])
            elif m:
                unset = _UNSET.search(m["pattern"])
                pattern = java_pattern(_UNSET.sub("", m["pattern"]))
                rule = FileRule(name, "header", m["name"], pattern, m["op"] == "!~", unset[1] if unset else None) if pattern is not None else None
        elif kind in ("body", "rawbody", "full", "uri"):
            pattern = java_pattern(rest)
            rule = FileRule(name, kind, "", pattern) if pattern is not None else None
        elif kind == "meta" and rest:
            out.rules.pop(name, None)
            out.metas[name] = rest
            continue
        elif kind == "score" and rest:
            out.scores[name] = float(rest.split()[-1])
            continue
        elif kind == "describe":
            out.texts[name] = rest
            continue
        elif kind == "tflags":
            out.flags[name] = rest.split()
            continue
        if rule is None:
            out.skipped.append(line.rstrip("\n"))
        else:
            out.metas.pop(name, None)
            out.rules[name] = rule
    return out


def _header_value(raw: Column, target: str) -> Column:
    """The first header of that name, folded lines joined; ``:addr`` and ``:name`` take one part, ``ALL`` all headers; null if absent."""
    name, *modes = target.split(":")
    if name == "ALL":
        return raw
    found = F.regexp_extract_all(raw, F.lit(rf"(?im)^{re.escape(name)}:[ \t]*((?:[^\r\n]|\r?\n[ \t])*+)"), F.lit(1))
    value = F.regexp_replace(F.get(found, F.lit(0)), r"\r?\n[ \t]+", " ")
    if "addr" in modes:
        value = F.when(value.contains("<"), F.regexp_extract(value, r"<([^<>]*)>", 1)).otherwise(F.trim(value))
    if "name" in modes:
        value = F.trim(F.replace(F.when(value.contains("<"), F.substring_index(value, "<", 1)).otherwise(F.lit("")), F.lit('"'), F.lit("")))
    return value


def predicate(rule: FileRule, raw: Column, body: Column) -> Column:
    """Whether a message meets a pattern rule; a null part is an empty one."""
    raw, body = F.coalesce(raw, F.lit("")), F.coalesce(body, F.lit(""))
    if rule.kind == "exists":
        return raw.rlike(rf"(?im)^{re.escape(rule.target)}:")
    if rule.kind == "header":
        value = _header_value(raw, rule.target)
        value = F.coalesce(value, F.lit(rule.unset)) if rule.unset is not None else value
        met = value.rlike(rule.pattern)
        return F.coalesce(~met, F.lit(True)) if rule.negated else F.coalesce(met, F.lit(False))
    if rule.kind == "uri":
        return F.exists(F.regexp_extract_all(body, F.lit(_LINK), F.lit(0)), lambda u: u.rlike(rule.pattern))
    if rule.kind == "full":
        return F.concat(raw, F.lit("\n"), body).rlike(rule.pattern)
    if rule.kind == "rawbody":
        return body.rlike(rule.pattern)
    # A body rule reads the subject as its first line, and white space as single spaces.
    subject = F.coalesce(_header_value(raw, "Subject"), F.lit(""))
    return F.concat_ws(" ", subject, F.regexp_replace(body, r"\s+", " ")).rlike(rule.pattern)


def findings(messages: DataFrame, rules: RuleSet, id_col: str = "id", raw_col: str = "raw", body_col: str = "body") -> DataFrame:
    """(id_col, symbol, score): the rules that each message meets, metas included.

    One pass over the messages evaluates all patterns. Atoms of metas that no
    rule has are 0. Metas that need each other raise CycleError.
    """
    met = F.array_compact(F.array(*[F.when(predicate(r, F.col(raw_col), F.col(body_col)), F.lit(n)) for n, r in rules.rules.items()])) if rules.rules else F.array().cast("array<string>")
    rows = messages.select(F.col(id_col).alias("id"), met.alias("met"))
    direct = rows.select("id", F.explode("met").alias("symbol"))
    metas = layers.evaluate(rows.select("id"), direct, [layers.Dependent(n, e) for n, e in rules.metas.items()])
    every = direct.unionByName(metas.select("id", "symbol")) if rules.metas else direct
    names = [n for n in (*rules.rules, *rules.metas) if not n.startswith("__")]
    if not names:
        return every.filter("false").select(F.col("id").alias(id_col), "symbol", F.lit(0.0).alias("score"))
    score = F.create_map(*[F.lit(x) for n in names for x in (n, rules.score(n))])
    return every.filter(~F.col("symbol").startswith("__")).select(F.col("id").alias(id_col), "symbol", score[F.col("symbol")].alias("score"))
