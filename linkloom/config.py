"""Fixed values of the contact model. They must keep exactly these values for results to agree."""

LB, UB, BB = 18, 29, 12  # golden-ratio histogram: lowest bucket, highest bucket, number of buckets
PHI = 0.4812118250596684  # ln((1 + sqrt 5) / 2)
OUTLIER_THRESHOLD = 3.5
MAD_SCALE = 0.67449
MIN_SIZE = 10_000
MIN_LINK_DIST = 1 << 11
MAX_LINK_DIST = 1 << 27
N_BINS = 256
GEOMETRIC_BIN_RATIO = 2 ** (1 / 16)
DEFAULT_RE = "GATC"
MIN_LINKS = 3
BIG_NORM = 10**12
LINK_DIST = 10**6
LIMIT = 10_000_000
SEED, NPOP, NGEN, MUTA_PROB = 42, 100, 5000, 0.2
MIN_RES, MAX_LINK_DENSITY, NON_INFORMATIVE_RATIO = 10, 2.0, 3.0
PROB_CUTOFF = 0.95
LINE_WIDTH = 60
GAP_SIZE = 100
HEATMAP_RESOLUTION = 250_000
BAD_FLAGS = 3844  # unmapped, secondary, QC-fail, duplicate, supplementary
DENSITY_CAP = 500_000

HEAD_RE = "#Contig\tRECounts\tLength"
HEAD_PAIRS = "#X\tY\tContig1\tContig2\tRE1\tRE2\tObservedLinks\tExpectedLinksIfAdjacent\tLabel"
HEAD_DISTRIBUTION = "#Bin\tBinStart\tBinSize\tNumLinks\tTotalSize\tLinkDensity"
HEAD_POSTPROB = "#SeqID\tStart\tEnd\tContig\tPostProb"
HEAD_CLUSTERS = "#Group\tnContigs\tContigs"


def golden_radii() -> list[int]:
    """Representative distance of each golden bucket: phi**k, rounded, for k = LB..UB."""
    phi = (1 + 5**0.5) / 2
    return [int(phi**k + 0.5) for k in range(LB, UB + 1)]


def bin_starts() -> list[int]:
    """The 257 edges of the geometric distance bins, 16 to an octave, truncated to whole bp."""
    edges = []
    for octave in range(16):
        at = float(MIN_LINK_DIST << octave)
        for _ in range(16):
            edges.append(int(at))
            at *= GEOMETRIC_BIN_RATIO
    return [*edges, MAX_LINK_DIST]
