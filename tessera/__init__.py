"""Index-shaped analytics on Spark: collections, ordered maps, graphs, full text, vectors, queues and sketches as DataFrames."""

from .operators.collection import Collection, Many, Range, Search, Unique, Vector, dangling
from .operators.dataset import Blobs, Dataset, Ref, addressed
from .operators.fulltext import SearchIndex
from .operators.graph import Graph
from .operators.sketches import Bloom, CountingBloom
from .operators.structures import Fifo, KeyedMap, LruMap, Nested, OrderedMap, PriorityQueue, Sequence, StringSet
from .operators.vectors import FlatIndex, InvertedFile
from .sources.catalog import Catalog

__all__ = ["Blobs", "Bloom", "Catalog", "Collection", "CountingBloom", "Dataset", "Fifo", "FlatIndex", "Graph", "InvertedFile", "KeyedMap", "LruMap", "Many", "Nested", "OrderedMap", "PriorityQueue", "Range", "Ref", "Search", "SearchIndex", "Sequence", "StringSet", "Unique", "Vector", "addressed", "dangling"]
