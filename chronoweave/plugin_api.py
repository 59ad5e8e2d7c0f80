"""What plugins are written against: a module's factory takes a configuration and makes a ``Plugin``.

    from chronoweave.plugin_api import Outcome

    class Lines:
        def init(self, runtime): ...
        def project(self, fact): return Outcome("success", fact["message"].count("\\n"))

    def create_plugin(config): return Lines()

A module may state the version of this interface that it was written for as ``PLUGIN_API``.
"""

from chronoweave.enrich.plugins import PLUGIN_API, Extension, Outcome, Plugin

__all__ = ["PLUGIN_API", "Extension", "Outcome", "Plugin"]
