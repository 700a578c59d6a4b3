"""One decision after another, in plain Python: what many decisions at once must come to."""

from __future__ import annotations

from collections import defaultdict

FINISHED = ("complete", "stale")


def kind_of(was, now):
    schema, content = was[0] != now[0], was[1] != now[1]
    return "both" if schema and content else "schema" if schema else "content" if content else None


class PlainBoard:
    """Rows as tuples in the order of the Board's columns."""

    def __init__(self, tasks, reads, writes, fps, causes):
        self.status = {(f, t): s for f, t, s, _ in tasks}
        self.finished = {(f, t): at for f, t, _, at in tasks}
        self.reads, self.readers = defaultdict(set), defaultdict(set)
        for f, t, d in reads:
            self.reads[f, t].add(d)
            self.readers[f, d].add(t)
        self.writes, self.writers = defaultdict(set), defaultdict(set)
        for f, t, d, _ in writes:
            self.writes[f, t].add(d)
            self.writers[f, d].add(t)
        self.fps = defaultdict(dict)
        for f, t, d, slot, s, c in fps:
            self.fps[f, d].setdefault(t, {})[slot] = (s, c)
        self.causes = defaultdict(dict)
        for f, t, by, author, hops, kind in causes:
            self.causes[f, t][by, author] = (hops, kind)
        self.ledger, self.incidents = [], []

    def standing(self, f, d):
        held = {w: s.get("observed", s.get("current")) for w, s in self.fps[f, d].items()}
        return {w: p for w, p in sorted(held.items()) if p}

    def verdict(self, f, d, seen):
        on = self.standing(f, d)
        if not on:
            return None
        if seen in on.values():
            return "current", None, seen
        for w, p in on.items():
            slots = self.fps[f, d][w]
            if "observed" in slots and slots.get("current") == seen:
                return "superseded-notice", w, p
            if slots.get("previous") == seen:
                return "superseded-report", w, p
        return "unknown", None, next(iter(on.values()))

    def cascade(self, f, origin, reporter):
        hops, level, n = {}, {origin}, 0
        while level:
            n += 1
            tasks = {t for d in level for t in self.readers[f, d] if t != reporter and self.status.get((f, t)) in FINISHED and t not in hops}
            hops.update(dict.fromkeys(tasks, n))
            level = {d for t in tasks for d in self.writes[f, t]}
        return hops

    def restored(self, f, reporter, identical, changed, found):
        if not identical or not self.causes[f, reporter]:
            return set()
        moved = (self.writes[f, reporter] - identical) | changed
        left = {}
        for (flow, t), status in self.status.items():
            if flow != f or t == reporter or t in found or status != "stale" or self.finished[f, t] is None or not self.causes[f, t]:
                continue
            cited, waits, sound = {by for by, _ in self.causes[f, t]}, set(), True
            for d in self.reads[f, t]:
                wrote = [w for w in self.writers[f, d] if (f, w) in self.status]
                if not wrote:
                    continue
                times = [self.finished[f, w] for w in wrote]
                noticed = any("observed" in self.fps[f, d].get(w, {}) for w in wrote)
                sound &= d not in moved and d not in cited and None not in times and not noticed and max(times) <= self.finished[f, t]
                waits |= {w for w in wrote if w != reporter and self.status[f, w] != "complete"}
            if sound:
                left[t] = waits
        placed = set()
        while more := {t for t, waits in left.items() if t not in placed and waits <= placed}:
            placed |= more
        return placed

    def decide(self, report, f, task, at, outputs, inputs):
        if task is not None and (not outputs or not set(outputs) <= self.writes[f, task]):
            return
        identical, changes = set(), []
        for d, fp in outputs.items():
            was = self.fps[f, d].get(task, {}).get("current")
            if was == fp:
                identical.add(d)
            elif was:
                changes.append((d, kind_of(was, fp), 0))
        late, noticed = {}, {}
        for d, fp in inputs.items():
            if d in outputs or (said := self.verdict(f, d, fp)) is None:
                continue
            if said[0] == "unknown":
                noticed[d] = fp
                changes.append((d, kind_of(said[2], fp), 1))
            elif said[0] != "current" and task is not None:
                late[d, said[1] if said[0] == "superseded-report" else None] = (1, kind_of(fp, said[2]))
        found = defaultdict(dict)
        for d, kind, unreported in changes:
            author = next(iter(self.writers[f, d])) if len(self.writers[f, d]) == 1 and not unreported else None
            for t, hops in self.cascade(f, d, task).items():
                found[t][d, author] = (hops, kind)
        restored = self.restored(f, task, identical, {d for d, _, _ in changes}, set(found)) if task is not None else set()
        for t, causes in found.items():
            self.causes[f, t].update(causes)
            self.status[f, t] = "stale"
        if task is not None:
            self.causes[f, task] = late
            self.finished[f, task] = at
            self.status[f, task] = "stale" if late else "complete"
            for d, fp in outputs.items():
                slots = self.fps[f, d].setdefault(task, {})
                if "current" in slots and slots["current"] != fp:
                    slots["previous"] = slots["current"]
                slots["current"] = fp
                slots.pop("observed", None)
        for t in restored:
            self.causes[f, t] = {}
            self.status[f, t] = "complete"
        for d, fp in noticed.items():
            for w in self.standing(f, d):
                self.fps[f, d][w]["observed"] = fp
        flagged = {t: min((h, by) for (by, _), (h, _) in c.items()) for t, c in found.items()}
        if late:
            flagged[task] = min((h, by) for (by, _), (h, _) in late.items())
        if flagged or restored:
            self.ledger.append((f, report, len(flagged), len(restored), "marked" if flagged else "cleared"))
        for one in self.incidents:
            if one["flow"] == f and one["closed_by"] is None and not any(by == one["dataset"] for t in one["tasks"] for by, _ in self.causes[f, t]):
                one["closed_by"] = report
        if flagged:
            hops, _, dataset = min((h, t, by) for t, (h, by) in flagged.items())
            self.incidents.append({"flow": f, "report": report, "dataset": dataset, "tasks": set(flagged), "closed_by": None})

    def summary(self):
        return {
            "record": sorted(self.ledger),
            "tasks": sorted((f, t, s, str(self.finished[f, t])) for (f, t), s in self.status.items()),
            "causes": sorted((f, t, by, str(a), h, k) for (f, t), c in self.causes.items() for (by, a), (h, k) in c.items()),
            "fps": sorted((f, t, d, slot, *fp) for (f, d), ws in self.fps.items() for t, slots in ws.items() for slot, fp in slots.items()),
            "incidents": sorted((i["flow"], i["report"], i["dataset"], len(i["tasks"]), str(i["closed_by"])) for i in self.incidents),
        }


def summary_of(*timelines):
    """The same, of what the library decided in one batch or several."""

    def every(name):
        return [r for t in timelines for r in getattr(t, name).collect()]

    board, closed = timelines[-1].board, {(r.flow, r.decision): r.closed_by for r in every("closures")}
    return {
        "record": sorted((r.flow, r.decision, r.affected, r.restored, r.event) for r in every("record")),
        "tasks": sorted((r.flow, r.task, r.status, str(r.finished_at)) for r in board.tasks.collect()),
        "causes": sorted((r.flow, r.task, r.caused_by, str(r.caused_by_task), r.hops, r.kind) for r in board.causes.collect()),
        "fps": sorted((r.flow, r.task, r.dataset, r.slot, r.schema_fp, r.content_fp) for r in board.fps.collect()),
        "incidents": sorted((r.flow, r.decision, r.dataset, r.flagged, str(closed.get((r.flow, r.decision)))) for r in every("incidents")),
    }
