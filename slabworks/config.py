"""Settings of the service: a TOML file, overridden by the command line."""

from __future__ import annotations

import argparse
import os
import tomllib
from dataclasses import dataclass

DEFAULT_FILE = "./slabworks.toml"


@dataclass
class Config:
    data: str = "data/"
    address: str = "127.0.0.1:8001"
    root_url: str = ""
    index: str = "./slabworks.index"

    @property
    def host_port(self) -> tuple[str, int]:
        host, _, port = self.address.rpartition(":")
        return host.strip("[]"), int(port)


def load(argv: list[str]) -> Config:
    """Options ``-c FILE``, ``-a ADDRESS``, ``--root-url URL``; the first folder named is served.

    Without ``-c`` the file in the working folder is read if there is one. Its keys
    are ``data``, ``address``, ``root_url`` and ``path`` in the table ``db``.
    """
    parser = argparse.ArgumentParser("slabworks", description="Serve the array datasets of a folder.")
    parser.add_argument("-c", "--config", help=f"configuration file (default: {DEFAULT_FILE})")
    parser.add_argument("-a", "--address", help="address to listen on (default: 127.0.0.1:8001)")
    parser.add_argument("--root-url", help="root URL of the service (default: none)")
    parser.add_argument("data", nargs="*", help='folder of datasets (default: "data/")')
    args = parser.parse_args(argv)
    config = Config()
    path = args.config or (DEFAULT_FILE if os.path.exists(DEFAULT_FILE) else None)
    if path:
        with open(path, "rb") as f:
            found = tomllib.load(f)
        for key in ("data", "address", "root_url"):
            setattr(config, key, found.get(key, getattr(config, key)))
        config.index = found.get("db", {}).get("path", config.index)
    if args.data:
        config.data = args.data[0]
    config.address = args.address or config.address
    config.root_url = args.root_url or config.root_url
    config.host_port  # noqa: B018  an address without a port is an error here
    return config
