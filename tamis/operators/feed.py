"""Taking over a rules feed: plain control flow on the driver, as a bundle is one small document.

The steps have a fixed order, and a bundle that fails one is refused with the reason; the rules in use then
stay. Signatures are checked by a function that the caller gives, so keys stay with the caller.
"""

from __future__ import annotations

import hashlib
import json
import subprocess
import sys
from collections.abc import Callable
from dataclasses import dataclass

from .ledger import LARGEST, validate_bundle

RULES_VERSION = "1.0.0"  #: of the rules that are compiled in
PERIOD, JITTER = 24 * 3600, 6 * 3600


@dataclass(frozen=True)
class Outcome:
    status: str  #: skipped, up-to-date, failed, refused or applied
    reason: str = ""
    bundle: dict | None = None
    sidecar: bytes | None = None  #: the list of malicious packages that came with it

    @property
    def provenance(self) -> str:
        """Where rules come from after this outcome, for a bundle that was applied or not."""
        return f"feed@{self.bundle['version']}" if self.bundle else "bundled"


def version_key(version: str) -> tuple[int, ...]:
    """Dotted numbers for comparison; missing parts are 0."""
    parts = [int(x) for x in version.split(".")]
    return tuple(parts + [0] * (4 - len(parts)))


def due(now: float, last: float | None, machine: str) -> bool:
    """Whether a pull is due: a day after the last try, and up to six hours more, the same each time for a machine."""
    if last is None:
        return True
    more = int(hashlib.sha256(machine.encode()).hexdigest()[:8], 16) % JITTER
    return now - last >= PERIOD + more


def runs_within(pattern: str, text: str, seconds: float = 1.0) -> bool:
    """Whether a pattern ends on a text in time, tried in a process of its own: a spinning match can only be killed."""
    code = "import re, sys; re.search(sys.argv[1], sys.argv[2])"
    try:
        return subprocess.run([sys.executable, "-c", code, pattern, text], timeout=seconds, check=False).returncode == 0
    except subprocess.TimeoutExpired:
        return False


PROBES = ("a" * 4000, "aA1 -_.=:/'\"" * 300, "\n \t" * 1500)  #: what patterns must get through in time


def slow_pattern(patterns: list[str], seconds: float = 2.0) -> int | None:
    """The first pattern that doesn't end on all probes in time; all run in one process, which tells how far it came."""
    code = "import json, re, sys\nfor p in json.load(sys.stdin)[0]:\n    for t in json.loads(sys.argv[1]): re.search(p, t)\n    print(1, flush=True)"
    begun = 0
    while begun < len(patterns):
        p = subprocess.Popen([sys.executable, "-c", code, json.dumps(PROBES)], stdin=subprocess.PIPE, stdout=subprocess.PIPE, text=True)
        try:
            out, late = p.communicate(json.dumps([patterns[begun:]]), timeout=seconds * 10)[0], False
        except subprocess.TimeoutExpired:
            p.kill()
            out, late = p.communicate()[0], True
        begun += out.count("1")
        if begun == len(patterns):
            return None
        if not late or not all(runs_within(patterns[begun], t, seconds) for t in PROBES):
            return begun  # spins, or isn't a pattern
        begun += 1  # slow only together with those before it
    return None


def update(fetch: Callable[[], tuple[dict, bytes, bytes]], current: dict | None, verify: Callable[[bytes, bytes], bool], allow_rollback: bool = False, is_due: bool = True, sidecar: Callable[[str], bytes] | None = None) -> Outcome:
    """What becomes of a feed's offer. fetch gives (manifest, bundle bytes, signature); current is the bundle in use.

    Patterns must end in time on probes. A file beside the bundle (lists.malicious_packages: file and sha256) is fetched
    by sidecar(file): one whose digest differs refuses the whole offer, one that can't be fetched leaves it out.
    """
    if not is_due:
        return Outcome("skipped", "not due", current)
    try:
        manifest, raw, signature = fetch()
    except OSError as e:
        return Outcome("failed", f"fetch: {e}", current)
    if len(raw) > LARGEST:
        return Outcome("refused", "too large", current)
    if hashlib.sha256(raw).hexdigest() != manifest.get("sha256"):
        return Outcome("refused", "digest", current)
    if not verify(raw, signature):
        return Outcome("refused", "signature", current)
    try:
        bundle = json.loads(raw)
    except ValueError:
        return Outcome("refused", "not JSON", current)
    if errors := validate_bundle(bundle):
        return Outcome("refused", "; ".join(errors), current)
    if bundle["version"] != manifest.get("version"):
        return Outcome("refused", "version differs from the manifest's", current)
    if current:
        new, old = version_key(bundle["version"]), version_key(current["version"])
        if new == old:
            return Outcome("up-to-date", "", current)
        if new < old and not allow_rollback:
            return Outcome("refused", "rollback", current)
    patterns = [(f"{name}/{r['id']}", r["pattern"]) for name, rules in bundle["rulesets"].items() for r in rules]
    if (k := slow_pattern([p for _, p in patterns])) is not None:
        return Outcome("refused", f"{patterns[k][0]} is too slow", current)
    beside = (bundle.get("lists") or {}).get("malicious_packages")
    if beside and sidecar:
        try:
            content = sidecar(beside["file"])
        except OSError as e:
            return Outcome("applied", f"without {beside['file']}: {e}", bundle)
        if hashlib.sha256(content).hexdigest() != beside.get("sha256"):
            return Outcome("refused", f"digest of {beside['file']}", current)
        return Outcome("applied", "", bundle, content)
    return Outcome("applied", "", bundle)
