"""Order-insensitive comparison of a Spark result with DuckDB's."""


def plain(value):
    if isinstance(value, float):
        return "nan" if value != value else format(value, ".9g")
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(plain, value)) + "]"
    if isinstance(value, dict):
        return str(sorted((plain(k), plain(v)) for k, v in value.items()))
    return str(value)


def same_rows(df, con, sql):
    columns = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    wanted = sorted(tuple(plain(dict(zip(names, r, strict=True))[c]) for c in columns) for r in result.fetchall())
    assert len(found) == len(wanted)
    assert found == wanted
