"""A plain-Python stream job, one row at a time, to check the operators against."""

from __future__ import annotations


class StreamJob:
    """Lanes dealt in turn, minimum watermark, windows with a late output."""

    def __init__(self, size, slide, lag, lanes):
        self.size, self.slide, self.lag, self.lanes = size, slide, lag, lanes

    def run(self, rows):
        """``rows``: (arrival, id, event) tuples in any order."""
        tops = [None] * self.lanes
        open_windows, self.metrics, self.trace, self.seen = {}, [], [], {}
        for turn, (arrival, log_id, event) in enumerate(sorted(rows)):
            wm = self._watermark(tops)
            last = event - event % self.slide + self.size
            ends = [e for e in range(last, event, -self.slide)]
            good = [e for e in ends if wm is None or e - 1 > wm]
            if not good:
                self.trace.append((arrival, log_id, "LATE", -1))
            for end in good:
                open_windows.setdefault((log_id % self.lanes, end), []).append(log_id)
            lane = turn % self.lanes
            tops[lane] = event if tops[lane] is None else max(tops[lane], event)
            wm = self._watermark(tops)
            self.seen[log_id] = None if wm is None else wm + self.lag + 1
            if wm is not None:
                self._fire(open_windows, wm, arrival)
        self.pending = open_windows
        return self

    def _watermark(self, tops):
        return None if None in tops else min(tops) - self.lag - 1

    def _fire(self, open_windows, wm, arrival):
        for task, end in sorted(k for k in open_windows if k[1] - 1 <= wm):
            ids = open_windows.pop((task, end))
            self.metrics.append((task, end, arrival, len(ids), max(ids) - min(ids) + 1, wm))
            self.trace += [(arrival, i, "NORMAL", end) for i in ids]
