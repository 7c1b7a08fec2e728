"""Repositories, folders and commands: slugs of remotes, paths within roots, how a session is taken up again."""

from __future__ import annotations

import re
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLUG_CHARS = 255
# How each provider's program takes a session up again.
RESUME = {
    "claude-code": ("claude", "--resume"),
    "codex": ("codex", "resume"),
    "pi": ("pi", "--session"),
    "grok-build": ("grok", "--resume"),
    "antigravity": ("agy", "--conversation"),
    "kimi-code": ("kimi", "--session"),
    "tencent-codebuddy": ("codebuddy", "--resume"),
    "opencode": ("opencode", "--session"),
}


def repo_slug(url: Column) -> Column:
    """host/owner/name of a remote by https, http, ssh or scp; null for paths, ports, drives and deeper names."""
    raw = F.regexp_replace(F.trim(url), "/+$", "")
    web = r"^(?:https?://|ssh://git@)([^/:]{2,})/+([^/\\]+)/([^/\\]+?)(?:\.git)?$"
    scp = r"^(?:git@)?([^/:@]{2,}|[^/:]{2,}@[^/:]+):/*([^/\\:]+)/([^/\\:]+?)(?:\.git)?$"
    bare = r"^([^/:]{2,})/+([^/\\:]+)/([^/\\:]+?)(?:\.git)?$"
    out = F.lit(None).cast("string")
    for pattern in (bare, scp, web):
        part = lambda k, p=pattern: F.trim(F.regexp_extract(raw, p, k))
        slug = F.concat(part(1), F.lit("/"), part(2), F.lit("/"), part(3))
        fine = raw.rlike(pattern) & (part(2) != "") & (part(3) != "") & (F.length(slug) <= SLUG_CHARS)
        out = F.when(fine, slug).otherwise(out)
    return F.when(raw.rlike(r"^file:|^[A-Za-z]:[\\/]"), F.lit(None).cast("string")).otherwise(out)


def git_remote(folder: str | None) -> str | None:
    """The address of ``origin`` in the configuration of the repository that a folder lies in; null where the folder, or such a repository, isn't there."""
    at = Path(folder) if folder and folder.strip() else None
    for place in (at, *at.parents) if at is not None and at.is_absolute() else ():
        try:
            text = (place / ".git" / "config").read_text("utf-8", "replace")
        except OSError:
            continue
        section = re.search(r'^\s*\[remote "origin"\]([^\[]*)', text, re.M)
        address = re.search(r"^\s*url\s*=\s*(\S+)", section[1], re.M) if section else None
        return address[1] if address else None
    return None


def remotes(claims: DataFrame) -> DataFrame:
    """(cwd, remote) of the distinct folders of resume claims, looked up where tasks run: folders that are not there have none."""

    @F.pandas_udf("string")
    def look(folders: pd.Series) -> pd.Series:
        return folders.map(git_remote)

    return claims.select("cwd").filter("cwd IS NOT NULL").distinct().select("cwd", look(F.col("cwd")).alias("remote"))


def normalize_path(path: str) -> str:
    """Forward slashes, no empty, ``.`` or ``..`` segments; must be absolute."""
    path = path.replace("\\", "/")
    if not re.match(r"(/|[A-Za-z]:/)", path):
        raise ValueError("path must be absolute")
    head = path[:2] if path[1:2] == ":" else ""
    out: list[str] = []
    for segment in path[len(head) :].split("/"):
        if segment == "..":
            if not out:
                raise ValueError("path leaves its root")
            out.pop()
        elif segment not in ("", "."):
            out.append(segment)
    return f"{head}/{'/'.join(out)}"


def within(path: str, root: str) -> bool:
    """By whole segments: /a/bc is not within /a/b."""
    path, root = normalize_path(path), normalize_path(root).rstrip("/")
    return path == root or path.startswith(f"{root}/")


def remap(path: Column, old_root: str, new_root: str) -> Column:
    """Paths within one root moved to another; others stay."""
    old, new = normalize_path(old_root).rstrip("/"), normalize_path(new_root).rstrip("/")
    inside = (path == old) | path.startswith(f"{old}/")
    return F.when(inside, F.concat(F.lit(new), F.substring(path, len(old) + 1, 1 << 30))).otherwise(path)


def longest_root(paths, roots):
    """Each path (path) with the longest root (root, provider_id) it lies in, by segments.

    A path has few ancestors, so it asks for each of them by an equal join.
    """
    parts = F.split("path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    asked = paths.withColumn("root", F.explode(ancestors))
    met = asked.join(roots.withColumn("root", F.regexp_replace("root", "/+$", "")), "root")
    return met.groupBy("path").agg(F.max_by(F.struct("root", "provider_id"), F.length("root")).alias("r")).select("path", "r.*")


def _quoted(token: Column) -> Column:
    """Bare or in double quotes; null for a token that no quoting makes safe in every shell."""
    unsafe = token.rlike(r'[\p{Cntrl}"$`%!]') | token.endswith("\\")
    needs = (token == "") | token.rlike(r"[\s&|;<>()^'*?\[\]{}~#]")
    return F.when(unsafe, F.lit(None).cast("string")).when(needs, F.concat(F.lit('"'), token, F.lit('"'))).otherwise(token)


def resume_command(provider: Column, session: Column, cwd: Column) -> Column:
    """The command that takes a session up again; null where the provider has none, the id is blank or a part is unsafe."""
    out = F.lit(None).cast("string")
    place = F.when(F.trim(cwd) != "", cwd)
    for name, (binary, flag) in RESUME.items():
        start = F.lit(f"{binary} {flag} ")
        if name == "opencode":
            start = F.when(place.isNull(), start).otherwise(F.concat(F.lit(f"{binary} "), _quoted(place), F.lit(f" {flag} ")))
        out = F.when(provider == name, F.concat(start, _quoted(session))).otherwise(out)
    run = F.when(F.trim(session) != "", out)
    return F.when(cwd.isNull(), run).otherwise(F.concat(F.lit("(cd "), _quoted(cwd), F.lit(" && "), run, F.lit(")")))


def resume_available(claims):
    """Claims with ``available``: a provider with a command, and one trusted session id; a missing folder does not matter."""
    return claims.withColumn("available", F.col("provider_id").isin(*RESUME) & (F.col("id_state") == "resolved") & (F.trim("provider_session_id") != ""))
