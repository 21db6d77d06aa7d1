"""Settings of the registered queries.

The events table has no arrival times, so delays are injected, and one second of
the delay model is stretched to one hour to match the density of the table.
"""

HOUR = 3_600_000
SCALE = 3_600
LANES = 3
LAG_HOURS = {"tumbling": (0, 0.5, 1, 1.5, 2, 2.5, 3, 5), "sliding": (0, 0.5, 1, 1.5, 2)}
LAGS = {kind: [int(h * HOUR) for h in hours] for kind, hours in LAG_HOURS.items()}
SIZE = 2 * HOUR
SLIDE = {"tumbling": SIZE, "sliding": HOUR}
LAG = HOUR
BUCKET = 24 * HOUR
CUTOFF_S = 20

# Stream feeds: slices of six days.
FEED_SLICE = 6 * 24 * HOUR

# The replay file counts seconds from the first day of the events.
FEED_START = 1_704_067_200_000

# The log is cut here for scans that go on where an earlier one ended.
RESUME_AT = FEED_START + 15 * 24 * HOUR

# The adaptive lag is chosen for every two days.
HORIZON = 48 * HOUR
