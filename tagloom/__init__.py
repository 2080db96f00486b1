"""tagloom: source trees and linked documents as DataFrames of tags, a weighted file graph, ranks and queries."""

__version__ = "0.1.0"
