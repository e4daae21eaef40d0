"""Archive readers, XML/JSON/robots/feed scans and derived inputs."""
