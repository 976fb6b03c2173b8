"""What the registered queries and their SQL twins are run with."""

from __future__ import annotations

from fileguard.params import EngineParams, HmmParams

# Model used by the registered queries: the means lie within the entropies of the derived file names.
HMM = HmmParams(pi=(0.6, 0.4), a=((0.95, 0.05), (0.1, 0.9)), mu=(3.55, 3.9), var=(0.04, 0.04))
PARAMS = EngineParams(hmm=HMM)
SINCE_ID = 2_500
#: Allowed delay of the registered streams, and the parts their rows arrive in.
DELAY_SECONDS = 10
PARTS = 3
#: Places (ten a poll) of a part of the snapshot stream: cuts lie inside polls.
POLL_CUT = 47
#: The second that most events are moved into to make a burst.
BURST_US = 1_706_000_000_000_000
