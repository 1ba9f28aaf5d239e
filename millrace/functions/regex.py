"""Checks of patterns before they enter a plan (T18). Spark runs Java's expressions, so Java's rules count."""

from __future__ import annotations

import re

from pyspark import SparkContext

_GROUP_HEAD = re.compile(r"\(\?(?:<[A-Za-z]\w*>|<?[=!]|[>:]|[a-zA-Z-]+:?)")
_QUANTIFIER = re.compile(r"(?:[*+?]|\{\d+(?:,\d*)?\})[?+]?")


def _class_end(pattern: str, at: int) -> int:
    """The place after the character class that begins at ``at``; classes may hold classes."""
    depth, k = 0, at
    while k < len(pattern):
        if pattern[k] == "\\":
            k += 1
        elif pattern[k] == "[":
            depth += 1
        elif pattern[k] == "]" and k > at + 1:
            depth -= 1
            if depth == 0:
                return k + 1
        k += 1
    return len(pattern)


def nested_quantifier(pattern: str) -> bool:
    """Whether a repeated group holds something repeated without bound, which can backtrack for ever."""
    holds = [False]  # for each open group: something in it repeats without bound
    atom = False  # the same for what stands before the place, if that is a group
    at = 0
    while at < len(pattern):
        c = pattern[at]
        if pattern.startswith("\\Q", at):
            end = pattern.find("\\E", at + 2)
            at, atom = (len(pattern) if end < 0 else end + 2), False
        elif c == "\\":
            at, atom = at + 2, False
        elif c == "[":
            at, atom = _class_end(pattern, at), False
        elif c == "(":
            head = _GROUP_HEAD.match(pattern, at)
            at, atom = (head.end() if head else at + 1), False
            holds.append(False)
        elif c == ")":
            atom = holds.pop() if len(holds) > 1 else False
            holds[-1] |= atom
            at += 1
        elif found := _QUANTIFIER.match(pattern, at):
            body = found[0]
            open_ended = body[0] in "*+" or ",}" in body
            many = open_ended or (body[0] == "{" and max(map(int, re.findall(r"\d+", body))) > 1)
            if atom and many:
                return True
            holds[-1] |= open_ended
            at, atom = found.end(), False
        else:
            at, atom = at + 1, False
    return False


def checked_pattern(pattern: str) -> str:
    """``pattern`` itself, or an error for one that is no regular expression or may backtrack without bound."""
    context = SparkContext._active_spark_context
    try:
        if context is None:
            re.compile(pattern)
        else:
            context._jvm.java.util.regex.Pattern.compile(pattern)
    except Exception as e:
        said = str(getattr(e, "java_exception", e)).splitlines()[0]
        raise ValueError(f"no regular expression: {pattern!r} ({said})") from e
    if nested_quantifier(pattern):
        raise ValueError(f"nested quantifiers are refused: {pattern!r}")
    return pattern
