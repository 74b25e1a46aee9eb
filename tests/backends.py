"""Backends that run inside the Python workers of the tests."""


class WrongDimensions:
    dimensions = 3

    def embed_batch(self, texts):
        return [[1.0, 2.0] for _ in texts]


class Shouter:
    def refine(self, raw, content_type):
        if "boom" in raw:
            raise ConnectionError("offline")
        if "blank" in raw:
            return "  ", "t", []
        return f" {raw.upper()} ", "  ", ["Work", "#Work", "ideas"] + [f"t{i}" for i in range(9)]


class Marker:
    """The length of the text as a one-dimensional vector."""

    dimensions = 1

    def embed_batch(self, texts):
        return [[float(len(t))] for t in texts]


class Batches:
    """Upper-cases; a batch with a bad text fails as a whole, a flaky one at first."""

    def __init__(self):
        self.calls = {}

    def refine_batch(self, raws, content_types):
        key = tuple(raws)
        self.calls[key] = self.calls.get(key, 0) + 1
        if any("boom" in r for r in raws):
            raise ConnectionError("offline")
        if any("flaky" in r for r in raws) and self.calls[key] < 3:
            raise TimeoutError("slow")
        if any("short" in r for r in raws) and len(raws) > 1:
            return []
        return [ValueError("refused") if "refuse" in r else (r.upper(), kind, ["Work"])
                for r, kind in zip(raws, content_types)]
