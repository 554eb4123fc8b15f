"""A pull request as a ref: its base branch, by the forge's public REST interface or by a function of the caller's."""

from __future__ import annotations

import json
import os
import re
import subprocess
import urllib.request
from collections.abc import Callable

from .git import _git, resolve_branch

_REMOTE = re.compile(r"github\.com[:/]([^/]+)/(.+?)(?:\.git)?/?$")


def token() -> str | None:
    """From the environment, else from the forge's own command line tool."""
    for name in ("GITHUB_TOKEN", "GH_TOKEN"):
        if os.environ.get(name):
            return os.environ[name]
    try:
        r = subprocess.run(["gh", "auth", "token"], capture_output=True, text=True, timeout=10)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return r.stdout.strip() or None if r.returncode == 0 else None


def repository(root: str) -> tuple[str, str]:
    """(owner, name) by the remote's address."""
    m = _REMOTE.search((_git(root, "remote", "get-url", "origin") or b"").decode().strip())
    if not m:
        raise ValueError("the remote names no repository of the forge")
    return m[1], m[2]


def _fetch(url: str, key: str | None) -> dict:
    ask = urllib.request.Request(url, headers={"Accept": "application/vnd.github+json", "User-Agent": "lattica"} | ({"Authorization": f"Bearer {key}"} if key else {}))
    with urllib.request.urlopen(ask, timeout=30) as f:
        return json.load(f)


def base_ref(root: str, number: int, fetch: Callable[[str, str | None], dict] = _fetch) -> str:
    """The local ref of the branch that the pull request goes to."""
    if number < 1:
        raise ValueError("a pull request's number is 1 or more")
    owner, name = repository(root)
    branch = fetch(f"https://api.github.com/repos/{owner}/{name}/pulls/{number}", token())["base"]["ref"]
    ref = resolve_branch(root, branch)
    if ref is None:
        raise ValueError(f"the base branch {branch} isn't here: fetch it first")
    return ref
