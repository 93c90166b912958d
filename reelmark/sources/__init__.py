"""Reading and writing traces, episode stores, bulk frames, clips and mask files."""
from .stores import EpisodeStore, read_arrays, register_stores, write_store  # noqa: F401
from .traces import *  # noqa: F403
