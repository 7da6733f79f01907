"""A recorder of what a job's builder calls made: vertices, edges, chains and figures.

Spark's own plan does the work; the record is for looking at a job before it runs.
"""

from __future__ import annotations

from dataclasses import dataclass, field

#: How rows go from one vertex to the next.
FORWARD, SHUFFLE, REBALANCE, BROADCAST = "FORWARD", "SHUFFLE", "REBALANCE", "BROADCAST"
EDGES = (FORWARD, SHUFFLE, REBALANCE, BROADCAST)


@dataclass
class Graph:
    name: str = "job"
    vertices: dict[int, dict] = field(default_factory=dict)
    edges: list[tuple[int, int, str]] = field(default_factory=list)

    def add_vertex(self, label: str, parallelism: int = 1, role: str = "operator") -> int:
        number = len(self.vertices)
        self.vertices[number] = {"label": label, "parallelism": parallelism, "role": role}
        return number

    def add_edge(self, source: int, target: int, kind: str = FORWARD) -> None:
        if kind not in EDGES:
            raise ValueError(f"unknown kind of edge {kind!r}")
        for v in (source, target):
            if v not in self.vertices:
                raise ValueError(f"no vertex {v}")
        self.edges.append((source, target, kind))

    def upstream(self, vertex: int) -> list[int]:
        return [a for a, b, _ in self.edges if b == vertex]

    def downstream(self, vertex: int) -> list[int]:
        return [b for a, b, _ in self.edges if a == vertex]

    def order(self) -> list[int]:
        """Vertices so that inputs come first; an error if there is a cycle."""
        waiting = {v: len(self.upstream(v)) for v in self.vertices}
        ready, out = [v for v, n in waiting.items() if not n], []
        for v in ready:
            out.append(v)
            for w in self.downstream(v):
                waiting[w] -= 1
                if not waiting[w]:
                    ready.append(w)
        if len(out) < len(self.vertices):
            raise ValueError("the job's graph has a cycle")
        return out

    def chains(self) -> list[list[int]]:
        """Runs of vertices that Spark can do in one stage: forward edges with nothing else going in or out."""
        follows = {}
        for a, b, kind in self.edges:
            if kind == FORWARD and len(self.downstream(a)) == 1 and len(self.upstream(b)) == 1:
                follows[a] = b
        starts = [v for v in self.order() if v not in follows.values()]
        out = []
        for v in starts:
            chain = [v]
            while chain[-1] in follows:
                chain.append(follows[chain[-1]])
            out.append(chain)
        return out

    def statistics(self) -> dict:
        roles = [v["role"] for v in self.vertices.values()]
        return {
            "name": self.name,
            "vertices": len(self.vertices),
            "edges": len(self.edges),
            "sources": roles.count("source"),
            "sinks": roles.count("sink"),
            "chains": len(self.chains()) if self.vertices else 0,
            "max_parallelism": max((v["parallelism"] for v in self.vertices.values()), default=0),
        }
