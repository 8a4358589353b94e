"""Paths: parts, relative forms, and the class of a path in a session."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prefixes that are never data.
SYSTEM_PREFIXES = ["/proc/", "/sys/", "/dev/", "/etc/", "/run/", "/usr/share/", "/var/lib/", "/var/cache/", "/usr/lib/os-release"]
# Prefixes of temporary files.
TEMP_PREFIXES = ["/tmp/Rtmp", "/tmp/cc", "/tmp/registration_", "/tmp/kernel-", "/tmp/kallichore-", "/tmp/.lark_cache", "/tmp/quarto-session", "/var/tmp/Rtmp"]
# Prefixes of environment that are independent of any runtime.
ENV_PREFIXES = ["/usr/lib/", "/usr/local/lib/", "/opt/", "/lib/", "/lib64/", "/usr/bin/", "/usr/local/bin/", "/bin/", "/usr/libexec/", "/usr/include/"]
# The same below a home folder. A recorder's own folder there is given as one of env_prefixes.
HOME_ENV = [".cache/", ".positron-server/", ".local/share/uv/", ".local/opt/", ".local/bin/", ".local/lib/", "R/x86_64-pc-linux-gnu-library/", "R/aarch64-unknown-linux-gnu-library/", ".gitconfig"]
STARTUP_FILE = r"^(\.Renviron.*|\.Rprofile|\.RData|\.Rhistory)$"
VERSION_CONTROL = r"/\.git/|/\.git$|/\.hg/|/\.svn/"
# Fixed value: files that tools leave while they work.
WORK_FILE = r"(^|/)(FCON|FSTREAM|FDATA|FDATA\.csv|FSIZES|FREPORT|FSUBS|FSUBS2|FSUBS\.f90|FSUBS_MU\.F90|FMSG|FLIB|PRSIZES\.f90|LINK\.LNK|LINKC\.LNK|compile\.lnk|nonmem|nmprd4p\.mod|OUTPUT|INTER|PRDERR|OFV\.TXT|JUNK|newline|garbage\.out|trash\.out|trash\.tmp|nmprd4p\.mod0|[^/]+\.knit\.md|[^/]+\.rmarkdown|gfortran\.txt|FILE\d+|fort\.\d+|tempzzzz\d*|temporaryfile\.xml|\w+\.set)$|(^|/)temp_dir/"
# Programs that help others.
HELPER_PROGRAMS = ["rm", "cp", "mv", "cat", "sed", "grep", "uname", "which", "date", "basename", "dirname", "mkdir", "ls", "sh",
                   "bash", "env", "wc", "tr", "head", "tail", "cut", "expr", "readlink", "touch", "sleep", "true", "false",
                   "test", "[", "chmod", "ln", "f951", "as", "x86_64-linux-gnu-as", "collect2", "ld", "cc1"]
# Programs that run a script named after them.
INTERPRETERS = ["bash", "sh", "dash", "perl", "python", "python3"]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def base(path) -> Column:
    return F.element_at(F.split(_c(path), "/"), -1)


def directory(path) -> Column:
    cut = F.regexp_replace(_c(path), "/[^/]*$", "")
    return F.when(cut == "", "/").otherwise(cut)


def extension(path) -> Column:
    return F.lower(F.regexp_extract(base(path), r"(\.[^.]*)$", 1))


def under(path, prefix) -> Column:
    """Whole components below ``prefix``; a prefix that ends in ``/`` is taken as text."""
    path, prefix = _c(path), _c(prefix)
    folder = F.when(prefix.endswith("/"), prefix).otherwise(F.concat(prefix, F.lit("/")))
    return (prefix != "") & ((path == prefix) | path.startswith(folder))


def clean(path) -> Column:
    """The path without ``.``, empty parts and resolvable ``..``."""
    parts = F.filter(F.split(_c(path), "/"), lambda p: (p != "") & (p != "."))

    def step(acc: Column, p: Column) -> Column:
        up = (p == "..") & (F.size(acc) > 0)
        return F.when(up, F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when(p == "..", acc).otherwise(
            F.concat(acc, F.array(p)))

    return F.concat(F.lit("/"), F.array_join(F.aggregate(parts, F.expr("CAST(array() AS ARRAY<STRING>)"), step), "/"))


def relative(folder, path) -> Column:
    """``path`` seen from ``folder``: the common parts go, each part left of the folder is one step up."""
    a = F.filter(F.split(_c(folder), "/"), lambda p: p != "")
    b = F.filter(F.split(_c(path), "/"), lambda p: p != "")
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1))),
                           lambda n: (n <= F.size(a)) & (n <= F.size(b)) & (F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n))))
    ups = F.array_repeat(F.lit(".."), F.greatest(F.size(a) - same, F.lit(0)))
    rest = F.slice(b, same + 1, F.greatest(F.size(b) - same, F.lit(0)))
    joined = F.array_join(F.concat(ups, rest), "/")
    return F.when(_c(folder) == "", _c(path)).when(joined == "", ".").otherwise(joined)


def _any_prefix(path: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [path.startswith(p) for p in prefixes], F.lit(False))


def path_class(path, project, *, log=None, home: str = "", named: Column | None = None, library: Column | None = None,
               env_prefixes: list[str] | None = None) -> Column:
    """self, project, temp, env, system or outside; the first rule that fits decides.

    ``named`` is whether the path lies under a prefix the session named, ``library`` whether an ancestor of the path
    is an installed package; ``operators.prefixes`` tells both from tables.
    """
    path, project = _c(path), _c(project)
    fixed = list(ENV_PREFIXES) + ([f"{home}/{p}" for p in HOME_ENV] if home else []) + list(env_prefixes or [])
    own = F.coalesce(named, F.lit(False)) if named is not None else F.lit(False)
    packaged = path.contains("/site-packages/") | path.contains("/dist-packages/")
    if library is not None:
        packaged = packaged | F.coalesce(library, F.lit(False))
    in_project = F.coalesce((project != "") & under(path, project), F.lit(False))
    rule = F.when(path == _c(log), "self") if log is not None else F.when(F.lit(False), "self")
    return (
        rule.when(in_project & (base(path).rlike(STARTUP_FILE) | path.rlike(VERSION_CONTROL)), "env")
        .when(in_project, "project")
        .when(_any_prefix(path, TEMP_PREFIXES), "temp")
        .when(reduce(lambda a, b: a | b, [under(path, F.lit(p)) for p in fixed]) | own, "env")
        .when(_any_prefix(path, SYSTEM_PREFIXES), "system")
        .when(packaged, "env")
        .otherwise("outside")
    )


def words(cmdline) -> Column:
    """The words of a recorded command line: parted at blanks, single quotes removed, ``\\'`` outside them a quote.

    Nothing else is special: double quotes and other backslashes belong to the word.
    """
    found = F.regexp_extract_all(_c(cmdline), F.lit(r"((?:'[^']*+(?:'|\z)|\\'|[^ \t\n'])+)"), 1)
    unquote = lambda w: F.regexp_replace(w, r"'([^']*+)(?:'|\z)|\\(')", "$1$2")
    return F.transform(found, unquote)


def program_name(program, cmdline) -> Column:
    """Base name of the program; for an interpreter the script it runs, unless the code is inline."""
    w = words(cmdline)
    name = base(F.coalesce(F.nullif(_c(program), F.lit("")), F.get(w, 0), F.lit("")))
    args = F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1)))
    inline = F.array_position(args, F.lit("-c"))
    before = F.when(inline > 0, F.slice(args, F.lit(1), (inline - 1).cast("int"))).otherwise(args)
    script = F.get(F.filter(before, lambda a: ~a.startswith("-")), 0)
    runs = name.isin(INTERPRETERS) | name.startswith("python3.")
    return F.when(runs & script.isNotNull(), base(script)).otherwise(name)


def work_file(path) -> Column:
    return _c(path).rlike(WORK_FILE)
