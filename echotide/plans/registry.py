"""Plug-ins by name: what they need, and the order that their dependencies set."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Plugin:
    """A function of the engine or a user, with its required arguments, dependencies and file suffixes."""

    name: str
    run: Callable
    required: tuple[str, ...] = ()
    depends: tuple[str, ...] = ()
    suffixes: tuple[str, ...] = ()


@dataclass
class Registry:
    """Plug-ins of one kind."""

    kind: str
    plugins: dict[str, Plugin] = field(default_factory=dict)

    def add(self, name: str, *, required: Iterable[str] = (), depends: Iterable[str] = (), suffixes: Iterable[str] = ()) -> Callable[[Callable], Callable]:
        """Decorator that registers a function."""

        def register(f: Callable) -> Callable:
            if name in self.plugins:
                raise ValueError(f"{self.kind} {name} is registered already")
            self.plugins[name] = Plugin(name, f, tuple(required), tuple(depends), tuple(suffixes))
            return f

        return register

    def get(self, name: str) -> Plugin:
        if name not in self.plugins:
            raise ValueError(f"unknown {self.kind}: {name}; known: {', '.join(sorted(self.plugins))}")
        return self.plugins[name]

    def chosen(self, names: Iterable[str] | None) -> list[Plugin]:
        """Plug-ins by name, without 'none'."""
        return [self.get(n) for n in names or () if n != "none"]

    def ordered(self, names: Iterable[str]) -> list[Plugin]:
        """The named plug-ins and all that they depend on, each once and after its dependencies."""
        out: dict[str, Plugin] = {}
        open_: list[str] = []

        def visit(name: str) -> None:
            if name in out:
                return
            if name in open_:
                raise ValueError(f"{self.kind} plug-ins depend on each other in a circle: {' -> '.join([*open_, name])}")
            open_.append(name)
            plugin = self.get(name)
            for d in plugin.depends:
                visit(d)
            open_.pop()
            out[name] = plugin

        for n in names:
            visit(n)
        return list(out.values())


def check_arguments(plugins: Iterable[Plugin], given: Mapping, exempt: Iterable[str] = ()) -> None:
    """ValueError where a required argument is missing."""
    free = set(exempt)
    for p in plugins:
        if missing := [a for a in p.required if a not in given and a not in free]:
            raise ValueError(f"{p.name} needs {', '.join(missing)}")


def check_suffix(plugin: Plugin, path: str) -> None:
    if plugin.suffixes and not path.endswith(plugin.suffixes):
        raise ValueError(f"{plugin.name} reads {', '.join(plugin.suffixes)}, not {path}")
