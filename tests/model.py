"""A plain fold of operations over a dict: what the engine has to agree with."""


class Model:
    def __init__(self, key, sort=()):
        self.key, self.sort, self.rows = key, sort, {}

    def insert(self, row):
        self.rows[tuple(row[c] for c in (*self.key, *self.sort))] = dict(row)
        return True

    def delete(self, identity):
        return self.rows.pop(tuple(identity), None) is not None

    def update(self, identity, changes):
        row = self.rows.get(tuple(identity))
        if row is not None:
            row.update(changes)
        return row is not None

    def get(self, keys):
        found = []
        for k in keys:
            own = sorted((i for i in self.rows if i[: len(self.key)] == tuple(k)), key=lambda i: i[len(self.key) :])
            found += [dict(self.rows[i]) for i in own]
        return found
