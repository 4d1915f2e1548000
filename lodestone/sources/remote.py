"""Hosted repositories as a Spark data source: ``spark.read.format("repository").options(...).load()``.

Options: kind ("versions": a version control tree, "git": a hosted Git
repository, "zip": an archive of a branch); base, project, repo, root, branch,
api_version and authorization as the service wants them; include and exclude,
globs with ";" between; tasks, into how many the paths are dealt. The listing
is read once, at planning, again with pauses while it is empty; contents are
read in the tasks, once for each path. A content that can't be read is null.
"""

from __future__ import annotations

import json
import re
import urllib.error
from collections.abc import Iterator
from urllib.parse import quote

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..config import Settings
from ..functions.text import glob_regex
from . import http
from .files import FILES, entries, globs


class Paths(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(len(paths))
        self.paths = paths


def wanted(path: str, include: str, exclude: str) -> bool:
    p = path.replace("\\", "/").lstrip("/")
    hit = lambda gs: any(re.match(glob_regex(g), p) for g in globs(gs))
    return (not globs(include) or hit(include)) and not hit(exclude)


def listed_files(body: str, kind: str) -> list[str]:
    """Paths of the files of a recursive listing; folders and broken pages are left out."""
    try:
        items = json.loads(body).get("value") or []
    except (ValueError, AttributeError):
        return []
    if kind == "versions":
        return [i["path"] for i in items if i.get("path") and not i.get("isFolder")]
    blob = lambda i: (i.get("gitObjectType") or "").lower() == "blob" or not i.get("gitObjectType") and not i.get("isFolder")
    return [i["path"] for i in items if i.get("path") and blob(i)]


class Service:
    """Addresses of one repository, in the services' own formats."""

    def __init__(self, options: dict[str, str]):
        o = {k.lower(): v for k, v in options.items()}
        self.kind, self.root, self.branch = o.get("kind", "git"), o.get("root", ""), o.get("branch", "")
        self.base, self.project, self.repo = o["base"].rstrip("/"), o.get("project", ""), o.get("repo", "")
        self.version, self.tasks = o.get("api_version", "7.0"), int(o.get("tasks", "32"))
        self.headers = {"Authorization": o["authorization"]} if o.get("authorization") else {}
        self.include, self.exclude = o.get("include", Settings.include), o.get("exclude", Settings.exclude)
        if self.kind not in ("versions", "git", "zip"):
            raise ValueError(f"unknown kind of repository: {self.kind}")

    def _items(self) -> str:
        tree = f"{self.base}/{self.project}/_apis"
        return f"{tree}/tfvc/items?" if self.kind == "versions" else f"{tree}/git/repositories/{quote(self.repo, safe='')}/items?"

    def _at_branch(self) -> str:
        return f"&versionDescriptor.version={quote(self.branch, safe='')}&versionDescriptor.versionType=branch" if self.branch and self.kind == "git" else ""

    def listing(self) -> str:
        scope = f"scopePath={quote(self.root, safe='')}&" if self.kind == "versions" else ""
        return f"{self._items()}{scope}recursionLevel=Full{self._at_branch()}&api-version={self.version}"

    def content(self, path: str) -> str:
        return f"{self._items()}path={quote(path, safe='')}&$format=text{self._at_branch()}&api-version={self.version}"

    def archive(self) -> str:
        branch = self.branch or self._default()
        return f"{self.base}/repos/{self.repo}/zipball/{quote(branch, safe='')}"

    def _default(self) -> str:
        try:
            return http.default_branch(http.get(f"{self.base}/repos/{self.repo}", self.headers))
        except OSError:
            return http.default_branch("")

    def relative(self, path: str) -> str:
        p = path.replace("\\", "/")
        return (p[len(self.root) :] if self.root and p.lower().startswith(self.root.lower()) else p).lstrip("/")


class Reader(DataSourceReader):
    def __init__(self, service: Service):
        self.s = service

    def partitions(self) -> list[InputPartition]:
        s = self.s
        if s.kind == "zip":
            return [Paths([s.archive()])]
        found = http.until_listed(lambda: listed_files(http.get(s.listing(), s.headers), s.kind))
        paths = [p for p in found if wanted(s.relative(p), s.include, s.exclude)]
        return [Paths(paths[k :: s.tasks]) for k in range(min(s.tasks, len(paths)))] or [Paths([])]

    def read(self, partition: Paths) -> Iterator[tuple[str, str | None]]:
        s = self.s
        for path in partition.paths:
            if s.kind == "zip":
                yield from ((p, t) for p, t in entries(http.fetch(path, s.headers)) if wanted(p, s.include, s.exclude))
                continue
            try:
                text = http.get(s.content(path), s.headers)
            except (OSError, urllib.error.URLError):
                text = None
            yield s.relative(path), text


class Repository(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> Reader:
        return Reader(Service(dict(self.options)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Repository)
