"""Scene folders for an external trainer: layout rules, bundles, command lines and expected outputs."""

from __future__ import annotations

import zipfile
from dataclasses import dataclass, field

from ..schema import IMAGE_EXTENSIONS
from ..sources import paths

#: Files of a binary model (fixed values).
MODEL_FILES = ("cameras.bin", "images.bin", "points3D.bin")


class SceneError(ValueError):
    """A scene that breaks a rule."""


@dataclass(frozen=True)
class Scene:
    """A sound scene folder."""

    root: str
    images: str
    model: str
    image_count: int
    extensions: list[str]
    model_files: list[str]


def model_files(folder: str) -> list[str]:
    """The files of a model folder, which must have all of MODEL_FILES."""
    if not paths.is_folder(folder):
        raise SceneError(f"{folder} is no folder")
    found = [x for x in paths.listed(folder) if paths.is_file(paths.joined(folder, x))]
    if lacking := [x for x in MODEL_FILES if x not in found]:
        raise SceneError(f"{folder} lacks {', '.join(lacking)}")
    return found


def image_names(folder: str) -> list[str]:
    """Paths of the images under a folder, at any depth."""
    out = []
    for name in paths.listed(folder):
        here = paths.joined(folder, name)
        if paths.is_folder(here):
            out += [f"{name}/{x}" for x in image_names(here)]
        elif name.lower().endswith(IMAGE_EXTENSIONS):
            out.append(name)
    return out


def check_scene(root: str, images: str = "images", expected: int | None = None) -> Scene:
    """The scene under root: images in one folder, a binary model in sparse/0."""
    folder, model = paths.joined(root, images), paths.joined(root, "sparse", "0")
    found = image_names(folder)
    if not found:
        raise SceneError(f"no image in {folder}")
    if expected is not None and len(found) != expected:
        raise SceneError(f"{len(found)} images in {folder}, not {expected}")
    return Scene(root, folder, model, len(found), sorted({"." + x.rsplit(".", 1)[1].lower() for x in found}), model_files(model))


def refuse_shipped_model(model: str, shipped: str) -> None:
    """A model that came with a dataset must not be passed off as our own reconstruction."""
    inside, outside = (paths.located(x)[1].rstrip("/") + "/" for x in (model, shipped))
    if inside.startswith(outside):
        raise SceneError(f"{model} came with the dataset")


def zip_folder(root: str, archive: str) -> list[str]:
    """A compressed archive of all files under root, sorted by path; the members."""

    def below(folder: str, prefix: str) -> list[str]:
        names = []
        for name in paths.listed(folder):
            here = paths.joined(folder, name)
            names += below(here, f"{prefix}{name}/") if paths.is_folder(here) else [prefix + name]
        return names

    members = sorted(below(root, ""), key=lambda x: x.split("/"))
    with paths.created(archive) as file, zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as out:
        for name in members:
            with paths.opened(paths.joined(root, name)) as source, out.open(name, "w") as target:
                while data := source.read(1 << 20):
                    target.write(data)
    return members


def _copied(source: str, target: str) -> None:
    with paths.opened(source) as file, paths.created(target) as out:
        while data := file.read(1 << 20):
            out.write(data)


def bundle_scene(images: str, model: str, target: str, archive: str | None = None, overwrite: bool = False, shipped: str | None = None) -> Scene:
    """A scene folder from existing images and model, zipped if wanted. A target with files is an error unless overwrite; nothing is left of it then."""
    if shipped:
        refuse_shipped_model(model, shipped)
    files, names = model_files(model), image_names(images)
    if not names:
        raise SceneError(f"no image in {images}")
    if paths.listed(target):
        if not overwrite:
            raise FileExistsError(target)
        paths.removed(target)
    for name in names:
        _copied(paths.joined(images, name), paths.joined(target, "images", name))
    for name in files:
        _copied(paths.joined(model, name), paths.joined(target, "sparse", "0", name))
    if archive:
        zip_folder(target, archive)
    return check_scene(target, expected=len(names))


@dataclass(frozen=True)
class Training:
    """One run of the external trainer. Iterations that are not given are the run's own."""

    source: str
    model: str
    iterations: int = 300
    images: str = "images"
    python: str = "python"
    quiet: bool = True
    viewer: bool = False
    test_at: tuple[int, ...] = (-1,)
    save_at: tuple[int, ...] | None = None
    checkpoint_at: tuple[int, ...] | None = None
    train_options: tuple[str, ...] = field(default=())
    render_options: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        if self.iterations <= 0 or not self.images or not self.python:
            raise SceneError("a run needs positive iterations, an image folder and an interpreter")

    def _begin(self, script: str) -> list[str]:
        return [self.python, script, "-s", self.source, "-m", self.model, "-i", self.images]

    def train_command(self) -> list[str]:
        at = {"--test_iterations": self.test_at, "--save_iterations": self.save_at, "--checkpoint_iterations": self.checkpoint_at}
        listed = [x for flag, values in at.items() for x in (flag, *map(str, (self.iterations,) if values is None else values))]
        return [*self._begin("train.py"), "--iterations", str(self.iterations), *listed, *["--disable_viewer"] * (not self.viewer), *["--quiet"] * self.quiet, *self.train_options]

    def render_command(self, iteration: int | None = None) -> list[str]:
        return [*self._begin("render.py"), "--iteration", str(self._at(iteration)), "--skip_test", *["--quiet"] * self.quiet, *self.render_options]

    def _at(self, iteration: int | None) -> int:
        chosen = self.iterations if iteration is None else iteration
        if chosen <= 0:
            raise SceneError("an iteration must be positive")
        return chosen

    def outputs(self, iteration: int | None = None) -> dict[str, str]:
        """Where the trainer leaves its checkpoint, point cloud and renders."""
        return {
            "checkpoint": paths.joined(self.model, f"chkpnt{self.iterations}.pth"),
            "point_cloud": paths.joined(self.model, "point_cloud", f"iteration_{self.iterations}", "point_cloud.ply"),
            "renders": paths.joined(self.model, "train", f"ours_{self._at(iteration)}", "renders"),
        }
